"""SQL that gives the same rows as the training-data queries, where SQL can express them."""

from __future__ import annotations

from codeloom.llm import handwritten as h
from codeloom.llm import truncation as t


def text(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


_BLANKS = "(' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11))"
_LAST = "string_split({x}, chr(10))[-1]"
_TICKS = "(length(core) - length(replace(core, {w}, '')))"
P1_VALUES = f"""
v0 AS (SELECT enrichment_id, config_id::VARCHAR AS config_id, origin, unnest(['intro', 'closing_summary']) AS field, unnest([intro, closing_summary]) AS t FROM enrichments),
v1 AS (SELECT *, rtrim(t, {_BLANKS}) AS x FROM v0 WHERE regexp_matches(t, '\\S')),
v2 AS (SELECT *, regexp_extract({_LAST.format(x='x')}, {text(t.MARK)}, 0) AS m FROM v1),
v3 AS (SELECT *, CASE WHEN m = '' THEN x ELSE rtrim(left(x, length(x) - length(m)), {_BLANKS}) END AS core FROM v2),
v4 AS (SELECT *, {_LAST.format(x='core')} AS last FROM v3),
v5 AS (SELECT *, length(last) < length(core) AS own FROM v4),
v AS (SELECT enrichment_id, config_id, origin, field, length(t) AS chars, strlen(t) AS bytes, CASE
        WHEN m <> '' OR ends_with(x, chr(65533)) THEN 'mark'
        WHEN {_TICKS.format(w="'```'")} / 3 % 2 <> 0 OR {_TICKS.format(w="'`'")} % 2 <> 0 THEN 'code'
        WHEN (regexp_matches(last, {text(t.TERMINAL)}) AND NOT regexp_matches(last, {text(t.DOTS)})) OR (own AND (regexp_matches(last, {text(t.CODE_LINE)}) OR regexp_matches(last, {text(t.SO_ON_LINE)}))) THEN 'proper'
        ELSE CASE WHEN own THEN 'line' ELSE 'run' END || CASE WHEN regexp_matches(last, {text(t.ITEM)}) THEN '-item' ELSE '' END
             || CASE WHEN own AND len(regexp_split_to_array(last, '\\s+')) < {t.LINE_WORDS} THEN '-short' ELSE '' END END AS ending FROM v5),
h0 AS (SELECT unnest(['config_id', 'origin']) AS source_kind, unnest([config_id, origin]) AS source, field, chars, bytes, ending FROM v),
h1 AS (SELECT source_kind, source, field, unnest(['chars', 'bytes']) AS measure, unnest([chars, bytes]) AS length, ending FROM h0),
h AS (SELECT source_kind, source, field, measure, length, ending, count(*) AS n FROM h1 GROUP BY ALL),
h2 AS (SELECT source_kind, source, field, measure, length, sum(n) AS n, coalesce(sum(n) FILTER (ending NOT IN ('proper', 'mark')), 0) AS n_open FROM h GROUP BY ALL),
h3 AS (SELECT *, sum(n_open) OVER (PARTITION BY source_kind, source, field, measure ORDER BY length RANGE BETWEEN {t.SPIKE_WINDOW} PRECEDING AND {t.SPIKE_WINDOW} FOLLOWING) - n_open AS near,
         coalesce(sum(n) OVER (PARTITION BY source_kind, source, field, measure ORDER BY length ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS above,
         sum(n) OVER (PARTITION BY source_kind, source, field, measure) AS total FROM h2),
spike AS (SELECT * FROM h3 WHERE n_open >= {t.SPIKE_LEAST} AND n_open > {t.SPIKE_RATIO} * near / {2 * t.SPIKE_WINDOW} AND above <= {t.MOST_ABOVE} * total),
k0 AS (SELECT ending, sum(CASE WHEN h.length = s.length THEN h.n ELSE 0 END) AS n_at, sum(CASE WHEN h.length = s.length THEN 0 ELSE h.n END) AS n_beside FROM h JOIN spike s
         ON h.source_kind = s.source_kind AND h.source IS NOT DISTINCT FROM s.source AND h.field = s.field AND h.measure = s.measure AND abs(h.length - s.length) <= {t.SPIKE_WINDOW}
         WHERE ending NOT IN ('proper', 'mark', 'code') GROUP BY ending),
kind AS (SELECT ending FROM k0 WHERE n_at >= {t.SPIKE_LEAST} AND n_at > {t.SPIKE_RATIO} * n_beside / {2 * t.SPIKE_WINDOW}),
lost AS (SELECT * FROM v WHERE ending IN ('mark', 'code') OR ending IN (SELECT ending FROM kind))"""


def _rates(source: str) -> str:
    return f"""SELECT '{source}' AS source_kind, a.source, a.field AS field_name, a.n AS n_values, coalesce(b.n, 0) AS n_lost, round(coalesce(b.n, 0) / a.n, 6) AS rate
FROM (SELECT {source}::VARCHAR AS source, field, count(*) AS n FROM v GROUP BY ALL) a LEFT JOIN (SELECT {source}::VARCHAR AS source, field, count(*) AS n FROM lost GROUP BY ALL) b
ON a.source IS NOT DISTINCT FROM b.source AND a.field = b.field"""


def _case(what: str) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v[what]}" for k, v in h.TUNED.items() if k != "default") + f" ELSE {h.TUNED['default'][what]} END"


def _says(pattern: str) -> str:
    return rf"len(list_filter(string_split(head, chr(10)), lambda y: regexp_matches(regexp_replace(y, '^\s*(?://+|#+|/\*+|\*+|--|;)\s?', ''), {text(pattern)}))) > 0"


_EXT = r"lower(regexp_extract(file_path, '\.([A-Za-z0-9]+)$', 1))"
LANGUAGE = f"CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in h.LANGUAGES.items()) + " END"
_SHAPE = r"""regexp_replace(regexp_replace(regexp_replace(l, '"[^"]*"|''[^'']*''', 's', 'g'), '[\pL_][\pL\pN_]*', 'a', 'g'), '\d[\d.]*', '0', 'g')"""
# hash signs that open a directive or an attribute are no comments; they are marked, so that one pattern finds the head
_MARKED = r"regexp_replace(x, '(^|\n)([ \t]*)#(include|define|pragma|if|!\[)', '\1\2¤\3', 'g')"
_HEAD = r"^(?:[ \t]*(?:<\?php)?[ \t]*(?:(?://|#|--|;)[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/[ \t]*)?\n)*"
P4_FILES = rf"""
f0 AS (SELECT file_id, repo, coalesce(file_path, '') AS file_path, {LANGUAGE} AS language, regexp_replace(replace(replace(coalesce(content, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^' || chr(65279), '') AS x FROM source_files),
f1 AS (SELECT *, length(x) AS n, list_filter(string_split(x, chr(10)), lambda l: trim(l) <> '') AS ls, regexp_extract_all(x, '[\pL\pN_.]+') AS ws, left(x, length(regexp_extract({_MARKED}, '{_HEAD}', 0))) AS head FROM f0),
f2 AS (SELECT *, len(ls) AS n_lines, coalesce(list_max(list_transform(ls, lambda l: length(l))), 0) AS max_line, n / greatest(len(ls), 1) AS mean_line,
         1 - length(translate(x, ' ' || chr(9) || chr(10) || chr(12) || chr(11), '')) / greatest(n, 1) AS space, 1 - length(regexp_replace(x, '[\pL\pN]+', '', 'g')) / greatest(n, 1) AS alnum,
         len(list_filter(ws, lambda w: w[1] BETWEEN '0' AND '9')) / (len(ws) + {h.PRIOR['words']}) AS numbers, (n - length(regexp_replace(x, '[A-Za-z0-9+/=]{{40,}}', '', 'g'))) / (n + {h.PRIOR['chars']}) AS encoded,
         (len(list_distinct(list_transform(ls, lambda l: {_SHAPE}))) + {h.PRIOR['lines']}) / (len(ls) + {h.PRIOR['lines']}) AS shapes, trim(regexp_replace(x[length(head) + 1:], '\s+', ' ', 'g')) AS body FROM f1),
f3 AS (SELECT *, space < {_case('space')} AND (mean_line > {_case('mean')} OR max_line > {h.LONG_LINE}) AS dense FROM f2),
f4 AS (SELECT file_id, repo, CASE WHEN body <> '' THEN sha256(body) END AS hash, CASE
         WHEN numbers >= {_case('numbers')} OR encoded >= {h.ENCODED_SHARE} OR (dense AND alnum >= {h.BLOB_ALNUM}) THEN 'data' WHEN dense OR regexp_matches(file_path, {text(h.MINIFIED_PATH)}) THEN 'minified'
         WHEN {_says(h.VENDORED_HEAD)} OR regexp_matches(file_path, {text(h.VENDORED_PATH)}) THEN 'vendored'
         WHEN {_says(h.GENERATED_HEAD)} OR regexp_matches(file_path, {text(h.GENERATED_PATH)}) OR shapes < {_case('shapes')} THEN 'generated' END AS own FROM f3),
f5 AS (SELECT file_id, repo, CASE WHEN own IS NOT NULL THEN own WHEN hash IN (SELECT hash FROM f4 WHERE own IS NOT NULL AND hash IS NOT NULL) THEN 'copy' END AS reason FROM f4),
w AS (SELECT repo FROM f5 WHERE repo IS NOT NULL GROUP BY repo HAVING regexp_matches(repo, {text(h.WHOLE_REPO)}) OR count(reason) >= {h.WHOLE_SHARE} * (count(*) + {h.PRIOR['files']})),
judged AS (SELECT file_id, repo, coalesce(reason, CASE WHEN repo IN (SELECT repo FROM w) THEN 'repository' END) AS reason FROM f5)"""


ORACLE = {
    "p1_found": f"WITH {P1_VALUES} SELECT DISTINCT enrichment_id, field AS field_name FROM lost",
    "p1_rates": f"WITH {P1_VALUES} {_rates('config_id')} UNION ALL {_rates('origin')}",
    "p1_limits": f"WITH {P1_VALUES} SELECT s.source_kind, s.source, s.field AS field_name, s.measure, s.length, s.n, s.n_open, c.max_tokens FROM spike s LEFT JOIN llm_configs c ON s.source_kind = 'config_id' AND s.source = c.config_id::VARCHAR",
    "p6_faults": "SELECT container, count(DISTINCT doc_id) AS n_items, 0 AS n_over, 0 AS n_split, 0 AS n_lost, true AS filled FROM pack_sizes, documents WHERE capacity_tokens > 0 GROUP BY container",
    "p7_faults": "SELECT t.source, count(d.doc_id) AS n_docs, 0 AS n_often, true AS reached FROM (SELECT DISTINCT source FROM mix_targets WHERE target_share > 0 AND max_repeats > 0) t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' GROUP BY t.source",
    "p4_found": f"WITH {P4_FILES} SELECT file_id FROM judged WHERE reason IS NOT NULL",
    "p4_reasons": f"WITH {P4_FILES} SELECT repo, coalesce(reason, 'hand') AS reason, count(*) AS n_files FROM judged GROUP BY ALL",
}
