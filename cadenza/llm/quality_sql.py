"""The quality verdicts in DuckDB's SQL, for comparison."""

from __future__ import annotations

from cadenza.llm.quality import RULES


def _quantiles(keys: str, source: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    at = lambda p: f"min(CASE WHEN run * 100 >= total * {p} THEN low END) AS q{p}"
    return f"""SELECT {by}, max(total) AS n, max(total - none) AS some, {at(25)}, {at(75)}, coalesce(min(CASE WHEN low > 0 AND (run - none) * 100 >= (total - none) * 25 THEN low END), 0) AS n25
      FROM (SELECT {by}, low, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS run, sum(n) OVER (PARTITION BY {by}) AS total, sum(CASE WHEN low = 0 THEN n ELSE 0 END) OVER (PARTITION BY {by}) AS none
            FROM (SELECT {by}, bucket, any_value(low) AS low, sum(n) AS n FROM {source} GROUP BY {by}, bucket)) GROUP BY {by}"""


def _fenced(source: str, most: str) -> str:
    rule = lambda i: "CASE measure " + " ".join(f"WHEN '{m}' THEN {r[i]}" for m, r in RULES.items()) + " END"
    width = f"(({rule(0)}) * (q75 - q25) + ({rule(1)}) * n25) // 10"
    above = f"greatest(q75 + {width}, {rule(2)})"
    return f"SELECT *, {f'least({above}, 4 * {most})' if most else above} AS above, q25 - {width} AS below FROM ({source})"


def _shrunk(source: str, up: str, keys: str, least: int) -> str:
    same = "d.measure = u.measure" + "".join(f" AND d.{k} IS NOT DISTINCT FROM u.{k}" for k in keys.split() if k)
    mean = lambda q, n: f"CAST(({n} * d.{q} + {least} * u.{q}) // ({n} + {least}) AS BIGINT) AS {q}"
    own = ", ".join(f"d.{k}" for k in (["lang", "source"] if keys else ["lang"]))
    return _fenced(f"SELECT {own}, d.measure, {mean('q25', 'd.n')}, {mean('q75', 'd.n')}, {mean('n25', 'd.some')}, u.above AS most FROM ({source}) d JOIN {up} u ON {same}", "most")


def oracle(least: int = 100) -> str:
    ws = r"[\x20\x09-\x0D]"
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m" for m in RULES)
    outside = " OR ".join([*(f"m.{m} > t.above_{m}" for m in RULES), "m.m_word_length < t.below_m_word_length"])
    pivot = ", ".join(f"max(CASE WHEN measure = '{m}' THEN above END) AS above_{m}, max(CASE WHEN measure = '{m}' THEN below END) AS below_{m}" for m in RULES)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '{ws}+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8)) AS n FROM r) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
st AS (SELECT doc_id, sum(CASE WHEN x = y THEN 1 ELSE 0 END) AS n FROM (SELECT doc_id, unnest(w[2:]) AS x, unnest(w[:-2]) AS y FROM w WHERE len(w) >= 2) GROUP BY doc_id),
b AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{ws}+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
        len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(st.n, 0) AS n_stutters
      FROM t JOIN w USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN st USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_symbols // n_words END AS m_symbols, CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines // n_lines END AS m_dup_lines,
        CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words // n_words END AS m_repeats, CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_stutters // n_words END AS m_stutters,
        CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * n_capitals // word_chars END AS m_capitals, CASE WHEN n_words = 0 THEN 0 ELSE 100 * word_chars // n_words END AS m_word_length FROM b),
v AS (SELECT lang, source, measure, CAST(v AS BIGINT) AS v, CASE WHEN v < 32 THEN 0 ELSE length(bin(CAST(v AS BIGINT))) - 5 END AS e FROM ({each})),
k AS (SELECT lang, source, measure, 16 * e + (v >> CAST(e AS BIGINT)) AS bucket, (v >> CAST(e AS BIGINT)) << CAST(e AS BIGINT) AS low, count(*) AS n FROM v GROUP BY ALL),
a AS ({_fenced(_quantiles("", "k"), "")}), l AS ({_shrunk(_quantiles("lang", "k"), "a", "", least)}), h AS ({_shrunk(_quantiles("lang, source", "k"), "l", "lang", least)}),
t2 AS (SELECT lang, source, {pivot} FROM h GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({outside}) AS kept
FROM m JOIN t2 t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source"""
