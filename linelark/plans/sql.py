"""DuckDB SQL for the named queries, written from the definitions with LIKE and substrings instead of tiers of patterns."""

from __future__ import annotations

from ..functions.score import add_or_delete_penalty, replacement_penalty

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}{_WS}]', '', 'g'), '[{_WS}]+', ' ', 'g'), ' ')"


_LINES = r"""
WITH lines AS (
  SELECT doc_id, source || '/' || doc_id || '.txt' AS source_text, unnest(l) AS line, CAST(unnest(range(len(l))) AS INTEGER) AS source_offset
  FROM (SELECT doc_id, source, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents)
), stripped AS (
  SELECT doc_id, source_text, source_offset, regexp_replace(line, '^[{ws}]+|[{ws}]+$', '', 'g') AS completed_sentence FROM lines
), searchable AS (
  SELECT *, {normal} AS normalized_sentence FROM stripped WHERE completed_sentence <> ''
), records AS (
  SELECT row_number() OVER (ORDER BY doc_id, source_offset) - 1 AS sentence_id, completed_sentence, normalized_sentence, source_text, source_offset
  FROM searchable WHERE normalized_sentence <> ''
)
""".replace("{ws}", _WS).replace("{normal}", _normal("completed_sentence"))


def _like(pattern: str, n: str) -> str:
    return f"{n} LIKE '%{pattern}%'"


def _score(query: str, n: str) -> str:
    """greatest() over every edit that fits; DuckDB's greatest skips nulls."""
    size = len(query)
    if not size:
        return "NULL"
    edits = [(2 * (size - 1) - replacement_penalty(p), query[:p] + "_" + query[p + 1 :]) for p in range(size)]
    edits += [(2 * (size - 1) - add_or_delete_penalty(p), query[:p] + query[p + 1 :]) for p in range(size)]
    edits += [(2 * size - add_or_delete_penalty(p), query[:p] + "_" + query[p:]) for p in range(1, size)]
    cases = ", ".join(f"CASE WHEN {_like(e, n)} THEN {s} END" for s, e in edits)
    return f"CAST(CASE WHEN length({n}) = 0 THEN NULL WHEN contains({n}, '{query}') THEN {2 * size} ELSE greatest({cases}, NULL) END AS INTEGER)"


_FOLD = "replace(lower(completed_sentence), 'ß', 'ss')"


def _top(query: str, where: str = "TRUE") -> str:
    order = f"score DESC, {_FOLD}, completed_sentence, source_text, source_offset"
    return f"""{_LINES}, scored AS (SELECT *, {_score(query, 'normalized_sentence')} AS score FROM records WHERE {where})
SELECT completed_sentence, source_text, source_offset AS "offset", score, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank
FROM scored WHERE score IS NOT NULL QUALIFY rank <= 5"""


def _both_ways(left: str, right: str) -> str:
    return f"SELECT *, 'left' AS side FROM ({left} EXCEPT ALL {right}) UNION ALL SELECT *, 'right' AS side FROM ({right} EXCEPT ALL {left})"


def _verified_records(query: str) -> str:
    """Window by window over the sentences that hold the query with some edit."""
    size = len(query)
    edits = {query[:p] + "_" + query[p + 1 :] for p in range(size)} | {query[:p] + query[p + 1 :] for p in range(size)} | {query[:p] + "_" + query[p:] for p in range(size + 1)}
    some = " OR ".join(_like(e, "normalized_sentence") for e in sorted(edits))
    kinds = {
        "exact": f"substr(n, w + 1, {size}) = '{query}'",
        "substitution": f"length(substr(n, w + 1, {size})) = {size} AND len(list_filter(range(1, {size + 1}), lambda i: substr(n, CAST(w + i AS BIGINT), 1) <> substr('{query}', CAST(i AS BIGINT), 1))) = 1",
        "insertion": " OR ".join(f"substr(n, w + 1, {size - 1}) = '{query[:p] + query[p + 1 :]}'" for p in range(size)),
        "deletion": f"length(substr(n, w + 1, {size + 1})) = {size + 1} AND (" + " OR ".join(f"substr(n, w + 1, {p}) = '{query[:p]}' AND substr(n, w + {p + 2}, {size - p}) = '{query[p:]}'" for p in range(size + 1)) + ")",
    }
    least = ", ".join(f"min(w) FILTER ({sql}) AS {kind}_at" for kind, sql in kinds.items())
    kind = "CASE " + " ".join(f"WHEN {k}_at IS NOT NULL THEN '{k}'" for k in kinds) + " END"
    first = "coalesce(" + ", ".join(f"{k}_at" for k in kinds) + ")"
    return f"""{_LINES}, windows AS (SELECT sentence_id, normalized_sentence AS n, unnest(range(length(normalized_sentence))) AS w FROM records WHERE {some}),
placed AS (SELECT sentence_id, {least} FROM windows GROUP BY sentence_id)
SELECT sentence_id, CAST({first} AS INTEGER) AS match_offset, {kind} AS edit_type FROM placed WHERE {first} IS NOT NULL"""


def _parts(queries: list[str]) -> str:
    return "WITH q AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in queries) + "]) AS query), pairs AS (SELECT p_partkey, query, p_name AS s, length(query) AS l FROM part, q)\n"


#: Windows compared position by position: w is the window's start, p the place of the edit, both from 0.
_WINDOWS = {
    "replacement_score": "SELECT 2 * (l - 1) - greatest(1, 5 - p) AS x FROM range(0, greatest(length(s) - l + 1, 0)) a(w), range(0, l) b(p) WHERE substr(s, w + 1, p) = substr(query, 1, p) AND substr(s, w + p + 1, 1) <> substr(query, p + 1, 1) AND substr(s, w + p + 2, l - p - 1) = substr(query, p + 2)",
    "extra_char_score": "SELECT 2 * (l - 1) - greatest(2, 10 - 2 * p) AS x FROM range(0, l) b(p) WHERE contains(s, substr(query, 1, p) || substr(query, p + 2))",
    "missing_char_score": "SELECT 2 * l - greatest(2, 10 - 2 * p) AS x FROM range(0, greatest(length(s) - l, 0)) a(w), range(0, l + 1) b(p) WHERE substr(s, w + 1, p) || substr(s, w + p + 2, l - p) = query",
}


def _windows(queries: list[str], *names: str) -> str:
    parts = [f"(SELECT max(x) FROM ({_WINDOWS[n]}))" for n in names]
    best = parts[0] if len(parts) == 1 else f"CASE WHEN contains(s, query) THEN 2 * l ELSE greatest({', '.join(parts)}) END"
    return f"{_parts(queries)}SELECT p_partkey, query, CAST({best} AS INTEGER) AS score FROM pairs"


def _verified(queries: list[str]) -> str:
    at = {
        "exact": "SELECT strpos(s, query) - 1 AS x WHERE contains(s, query)",
        "substitution": "SELECT w AS x FROM range(0, greatest(length(s) - l + 1, 0)) a(w) WHERE len(list_filter(range(1, l + 1), lambda i: substr(s, CAST(w + i AS BIGINT), 1) <> substr(query, CAST(i AS BIGINT), 1))) = 1",
        "insertion": "SELECT strpos(s, substr(query, 1, p) || substr(query, p + 2)) - 1 AS x FROM range(0, l) b(p) WHERE contains(s, substr(query, 1, p) || substr(query, p + 2))",
        "deletion": "SELECT w AS x FROM range(0, greatest(length(s) - l, 0)) a(w), range(0, l + 1) b(p) WHERE substr(s, w + 1, p) || substr(s, w + p + 2, l - p) = query",
    }
    found = ", ".join(f"(SELECT min(x) FROM ({sql})) AS {kind}_at" for kind, sql in at.items())
    kind = "CASE " + " ".join(f"WHEN {k}_at IS NOT NULL THEN '{k}'" for k in at) + " END"
    first = "coalesce(" + ", ".join(f"{k}_at" for k in at) + ")"
    return f"{_parts(queries)}, placed AS (SELECT p_partkey, query, {found} FROM pairs) SELECT p_partkey, query, {first} IS NOT NULL AS matched, CAST({first} AS INTEGER) AS match_offset, {kind} AS edit_type FROM placed"


def _halves(query: str, n: str) -> str:
    half = len(query) // 2
    return f"(contains({n}, '{query[:half]}') OR contains({n}, '{query[half:]}'))"


def _metrics(queries: list[str]) -> str:
    n, rows = "normalized_sentence", []
    for q in queries:
        passed = "TRUE" if len(q) < 4 else _halves(q, n)
        rows.append(f"SELECT '{q}' AS query, CAST({len(q)} AS INTEGER) AS length, '{'all' if len(q) < 4 else 'halves'}' AS mode, count(*) FILTER ({passed}) AS candidates, count(*) FILTER ({_score(q, n)} IS NOT NULL) AS matches, count(*) AS total FROM records")
    return f"{_LINES}, metrics AS MATERIALIZED ({' UNION ALL '.join(rows)})"


def _pick(key: str, salt: str, n: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({key} || '-{salt}'), 1, 8) AS BIGINT) % ({n}) AS INTEGER)"


def _queries_of(seed: str, digits: int) -> str:
    """made: each of picked (i, kind, n) with a query, by the rule of its kind."""
    k = "CAST(i AS VARCHAR)"
    return f"""sized AS (SELECT *, least(length(n), 8 + {_pick(k, seed + 'l', '13')}) AS size, list_filter(string_split(n, ''), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS letters FROM picked),
placed AS (SELECT *, {_pick(k, seed + 's', 'length(n) - size + 1')} AS o, {_pick(k, seed + 'p', 'size')} AS p, letters[{_pick(k, seed + 'c', 'len(letters)')} + 1] AS letter FROM sized), cuts AS (SELECT *, substr(n, o + 1, size) AS c FROM placed),
made AS (SELECT *, CASE kind WHEN 'exact' THEN c WHEN 'substitution' THEN substr(c, 1, p) || CASE WHEN substr(c, p + 1, 1) = 'x' THEN 'z' ELSE 'x' END || substr(c, p + 2) WHEN 'insertion' THEN substr(c, 1, p) || 'x' || substr(c, p + 1)
  WHEN 'deletion' THEN substr(c, 1, p) || substr(c, p + 2) WHEN 'no-match' THEN '999999' || lpad({k}, {digits}, '0') ELSE letter END AS query FROM cuts)"""


def oracle_sql() -> dict[str, str]:
    from . import BATCH, DELETED, EXACT, INSERTED, LONG, MEASURED, PATTERN, SCORED, SUBSTITUTED
    from ..functions.text import normalize_text
    from ..operators.metrics import WORDS

    ids = lambda where: f"{_LINES} SELECT sentence_id FROM records WHERE {where}"
    scored = lambda q: ids(f"{_score(q, 'normalized_sentence')} IS NOT NULL")
    metrics = _metrics(MEASURED)
    classes = "CASE WHEN length <= 2 THEN '1-2' WHEN length <= 5 THEN '3-5' WHEN length <= 10 THEN '6-10' WHEN length <= 20 THEN '11-20' ELSE '21+' END"
    order = f"score DESC, {_FOLD}, completed_sentence, source_text, source_offset"
    batch = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_id, '{normalize_text(q)}' AS query, *, {_score(normalize_text(q), 'normalized_sentence')} AS score FROM records" for i, q in BATCH)
    nations = f"WITH named AS (SELECT CAST(n_nationkey AS BIGINT) AS sentence_id, {_normal('n_name')} AS n FROM nation), starts AS (SELECT sentence_id, n, CAST(coalesce(sum(length(n) + 1) OVER (ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM named)"
    seed = "20260812"
    words = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    k = "CAST(i AS VARCHAR)"
    return {
        "load_lines": f"{_LINES} SELECT doc_id, source_text, source_offset, line FROM lines",
        "normalized_lines": f"{_LINES} SELECT doc_id, source_offset, completed_sentence, normalized_sentence FROM searchable WHERE normalized_sentence <> ''",
        "normalized_pages": f"SELECT page_id, {_normal('html')} AS normalized FROM pages",
        "casefolded_lines": f"{_LINES} SELECT sentence_id, {_FOLD} AS folded FROM records",
        "sentence_ids": f"{_LINES} SELECT * FROM records",
        "first_n_records": f"{_LINES} SELECT * FROM records WHERE sentence_id < 500",
        "corpus_violations": f"{_LINES} SELECT count(*) FILTER (normalized_sentence = '') AS empty, count(*) FILTER (contains(normalized_sentence, chr(0))) AS nul, CAST(greatest(coalesce(max(sentence_id) + 1, 0), count(*)) - count(DISTINCT sentence_id) AS BIGINT) AS gaps FROM records",
        "verified_matches": _verified_records(SUBSTITUTED),
        "top5_empty_text": _top(""),
        "indexed_minus_brute": _both_ways(f"SELECT * FROM ({_top(DELETED, _halves(DELETED, 'normalized_sentence'))})", f"SELECT * FROM ({_top(DELETED)})"),
        "result_differences": _both_ways(f"SELECT * FROM ({_top(EXACT)})", f"SELECT * FROM ({_top(SUBSTITUTED)})"),
        "exact_sentence_ids": ids(f"contains(normalized_sentence, '{PATTERN}')"),
        "exact_occurrences": f"{_LINES} SELECT sentence_id, CAST(o AS INTEGER) AS match_offset FROM (SELECT sentence_id, normalized_sentence AS n, unnest(range(length(normalized_sentence))) AS o FROM records WHERE contains(normalized_sentence, 'thth')) WHERE substr(n, o + 1, 4) = 'thth'",
        "anchor_candidates": ids(_halves(SUBSTITUTED, "normalized_sentence")),
        "half_candidates": ids(_halves("zqk", "normalized_sentence")),
        "short_candidates_1": ids("TRUE"),
        "short_candidates_2": scored("zq"),
        "short_candidates_3": scored("zqk"),
        "penalties": "SELECT DISTINCT p_size, CAST(greatest(1, 5 - p_size) AS INTEGER) AS replacement, CAST(greatest(2, 10 - 2 * p_size) AS INTEGER) AS add_or_delete FROM part",
        **{n: _windows(SCORED, n) for n in _WINDOWS},
        "best_match_score": _windows(SCORED, *_WINDOWS),
        "verify_one_edit": _verified(SCORED),
        "top5_exact": _top(EXACT),
        "top5_substitution": _top(SUBSTITUTED),
        "top5_insertion": _top(INSERTED),
        "top5_deletion": _top(DELETED),
        "top5_one_char": _top("z"),
        "top5_long": _top(LONG),
        "indexed_top5_long": _top(LONG),
        "indexed_top5_substitution": _top(SUBSTITUTED),
        "indexed_top5_short": _top("zq"),
        "index_grams": f"{_LINES}, grams AS (SELECT DISTINCT sentence_id, unnest(list_transform(range(1, length(normalized_sentence) - 1), lambda i: substr(normalized_sentence, CAST(i AS BIGINT), 3))) AS gram FROM records WHERE length(normalized_sentence) >= 3) SELECT gram, count(*) AS n FROM grams GROUP BY gram",
        "top5_two_chars": _top("zq"),
        "top5_no_match": _top("qqqqqqqq"),
        "top5_messy_text": _top("and the"),
        "top5_brute_force": _top(SUBSTITUTED),
        "batch_top5": f'{_LINES}, scored AS ({batch}) SELECT query_id, query, completed_sentence, source_text, source_offset AS "offset", score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS rank FROM scored WHERE score IS NOT NULL QUALIFY rank <= 5',
        "batch_candidates": _LINES + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_id, sentence_id FROM records WHERE {_halves(normalize_text(q), 'normalized_sentence')}" for i, q in BATCH),
        "corpus_stats": f"{_LINES} SELECT count(*) AS sentences, count(DISTINCT source_text) AS sources, CAST(sum(length(normalized_sentence) + 1) - 1 AS BIGINT) AS corpus_chars FROM records",
        "index_memory": f"{_LINES}, s AS (SELECT count(*) AS n, CAST(sum(length(normalized_sentence) + 1) - 1 AS BIGINT) AS c FROM records) SELECT 4 * c AS suffix_array_bytes, 4 * n AS sentence_starts_bytes, 12 * c AS workspace_bytes, 16 * c + 4 * n AS build_peak_bytes FROM s",
        "lines_per_source": f"{_LINES} SELECT source_text, count(*) AS lines FROM records GROUP BY source_text",
        "query_metrics": f"{metrics} SELECT * FROM metrics",
        "candidate_summary": f"{metrics} SELECT avg(candidates) AS mean_candidates, median(candidates) AS median_candidates, list_sort(list(candidates))[greatest(1, CAST(floor(0.95 * count(*)) AS BIGINT))] AS p95_candidates, 100 * (1 - avg(candidates) / max(total)) AS reduction_percent FROM metrics",
        "length_classes": f"{metrics} SELECT length_class, count(query) AS queries, avg(candidates) AS mean_candidates, median(candidates) AS median_candidates, avg(matches) AS mean_matches FROM (SELECT unnest(['1-2', '3-5', '6-10', '11-20', '21+']) AS length_class) LEFT JOIN (SELECT *, {classes} AS length_class FROM metrics) USING (length_class) GROUP BY length_class",
        "filter_modes": f"{metrics} SELECT mode, count(*) AS queries, avg(candidates) AS mean_candidates, avg(matches) AS mean_matches FROM metrics GROUP BY mode",
        "most_candidates": f"{metrics} SELECT query, candidates FROM metrics ORDER BY candidates DESC, query LIMIT 10",
        "pearson": f"{metrics} SELECT round(coalesce(corr(length, candidates), 0), 9) AS correlation FROM metrics",
        "generated_queries": f"""{_LINES}, picked AS (SELECT sentence_id AS i, sentence_id, ['exact', 'substitution', 'insertion', 'deletion', 'no-match', 'short'][sentence_id % 6 + 1] AS kind, normalized_sentence AS n FROM records WHERE length(normalized_sentence) >= 8),
{_queries_of(seed, 6)} SELECT sentence_id, kind, query FROM made""",
        "experiment_queries": f"""{_LINES}, numbers AS (SELECT range AS i, CASE WHEN range < 35 THEN 'exact' WHEN range < 70 THEN 'substitution' WHEN range < 105 THEN 'insertion' WHEN range < 140 THEN 'deletion' WHEN range < 175 THEN 'no-match' ELSE 'short-query' END AS kind FROM range(200)),
drawn AS (SELECT *, CAST({_pick(k, '20260811i', '(SELECT count(*) FROM records)')} AS BIGINT) AS sentence_id FROM numbers), picked AS (SELECT i, sentence_id, kind, normalized_sentence AS n FROM drawn JOIN records USING (sentence_id)),
{_queries_of('20260811', 4)} SELECT CAST(i AS INTEGER) AS number, sentence_id, kind, query FROM made""",
        "synthetic_sentences": f"""WITH ids AS (SELECT range AS i FROM range(10000)), picked AS (SELECT i, {words} AS words, list_transform(range(1, 4 + {_pick(k, '20260811', '3')}), lambda j: CAST('0x' || substr(md5(i || '-' || j || '-20260811'), 1, 8) AS BIGINT) % {len(WORDS)} + 1) AS js FROM ids),
said AS (SELECT i, array_to_string(list_transform(js, lambda j: words[j]), ' ') AS t FROM picked) SELECT i AS sentence_id, upper(substr(t, 1, 1)) || substr(t, 2) AS sentence FROM said""",
        "suffix_array": f"{nations}, joined AS (SELECT string_agg(n, chr(0) ORDER BY sentence_id) AS c FROM named) SELECT CAST(row_number() OVER (ORDER BY substr(c, p + 1)) - 1 AS INTEGER) AS rank, CAST(p AS INTEGER) AS position FROM (SELECT c, unnest(range(length(c))) AS p FROM joined)",
        "position_to_sentence": f"{nations} SELECT start + o AS position, sentence_id, CAST(o AS INTEGER) AS match_offset FROM (SELECT sentence_id, start, unnest(range(length(n))) AS o FROM starts)",
        "sentence_starts": f"{_LINES} SELECT sentence_id, CAST(coalesce(sum(length(normalized_sentence) + 1) OVER (ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(normalized_sentence) AS INTEGER) AS length FROM records",
    }
