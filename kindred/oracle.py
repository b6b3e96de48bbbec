"""The engine's string measures as expressions of DuckDB's SQL, from their published definitions, to check the engine by."""

from __future__ import annotations


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence, by the classic table, a row a letter of b."""
    cell = f"CASE WHEN substring({a}, i, 1) = ch THEN above[i] + 1 ELSE greatest(now[i], above[i + 1]) END"
    row = f"list_reduce(range(1, length({a}) + 1), lambda now, i: list_append(now, {cell}), [0]::BIGINT[])"
    return f"list_last(list_reduce(string_split({b}, ''), lambda above, ch: {row}, list_transform(range(0, length({a}) + 1), lambda i: 0)::BIGINT[]))"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 100.0 ELSE 200.0::DOUBLE * {common(a, b)} / (length({a}) + length({b})) END"


def in_order(a: str) -> str:
    """a's words, sorted."""
    return f"array_to_string(list_sort(list_filter(string_split({a}, ' '), lambda w: w <> '')), ' ')"


def _words(a: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({a}, ' '), lambda w: w <> '')))"


def ratios(source: str, name: str, pairs: dict[str, tuple[str, str]]) -> str:
    """CTEs that end with `name`: (a, b, ratio, sort, set) of the distinct pairs of texts that the columns of `source` hold."""
    each = " UNION ".join(f"SELECT DISTINCT {a} AS a, {b} AS b FROM {source}" for a, b in pairs.values())
    return f"""{name}_1 AS (SELECT *, {in_order('a')} AS sa, {in_order('b')} AS sb, {_words('a')} AS wa, {_words('b')} AS wb FROM ({each})),
{name}_2 AS (SELECT *, list_sort(list_intersect(wa, wb)) AS met FROM {name}_1),
{name}_3 AS (SELECT *, array_to_string(met, ' ') AS shared, trim(concat(array_to_string(met, ' '), ' ', array_to_string(list_filter(wa, lambda w: NOT list_contains(met, w)), ' '))) AS la,
  trim(concat(array_to_string(met, ' '), ' ', array_to_string(list_filter(wb, lambda w: NOT list_contains(met, w)), ' '))) AS lb FROM {name}_2),
{name} AS (SELECT a, b, {ratio('a', 'b')} AS ratio, {ratio('sa', 'sb')} AS sort, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 WHEN len(met) > 0 AND (len(met) = len(wa) OR len(met) = len(wb)) THEN 100.0
  WHEN len(met) = 0 THEN {ratio('la', 'lb')} ELSE greatest({ratio('la', 'lb')}, 200.0::DOUBLE * length(shared) / (length(shared) + length(la)), 200.0::DOUBLE * length(shared) / (length(shared) + length(lb))) END AS set FROM {name}_3)"""


def rule(source: str, name: str) -> str:
    """CTEs that end with `name`: source's rows (raw, normalised and tokenised texts of both sides: rn, ra, nn, an, nu, au, and the same after x_) with the rule's score."""
    fields = {"n": ("nn", "x_nn"), "a": ("an", "x_an")}
    numbers = lambda c: f"list_filter({c}, lambda w: regexp_full_match(w, '[0-9]+'))"
    postal = lambda c: f"list_filter({c}, lambda w: regexp_full_match(w, '[0-9]{{4,10}}'))"
    jaccard = lambda x, y: f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len(list_distinct(list_concat({x}, {y}))) END"
    overlap = lambda x, y: f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / least(len({x}), len({y})) END"
    equal = lambda x, y: f"CAST({x} <> '' AND {x} = {y} AS INTEGER)"
    score = f"""0.36 * fn.ratio + 0.24 * fn.set + 0.08 * fn.sort + 0.12 * fa.ratio + 0.12 * fa.set + 0.04 * fa.sort + 8.0 * ({jaccard('p.nu', 'p.x_nu')}) + 5.0 * ({jaccard('p.au', 'p.x_au')})
  + 3.0 * ({overlap(numbers('p.au'), numbers('p.x_au'))}) + 2.0 * CAST(len(list_intersect({postal('p.au')}, {postal('p.x_au')})) > 0 AS INTEGER) + 8.0 * {equal('p.nn', 'p.x_nn')} + 7.0 * {equal('p.an', 'p.x_an')}"""
    return f"{ratios(source, name + '_f', fields)},\n{name} AS (SELECT p.*, round(least(100.0::DOUBLE, CAST({score} AS DOUBLE)), 6) AS rule FROM {source} p JOIN {name}_f fn ON fn.a = p.nn AND fn.b = p.x_nn JOIN {name}_f fa ON fa.a = p.an AND fa.b = p.x_an)"


def latin(a: str) -> str:
    """Latin letters without their marks, in lower case."""
    return f"strip_accents(replace(replace(replace(lower({a}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))"


def secondary(a: str) -> str:
    x = f"regexp_replace({latin(a)}, 'https?://|www\\.', ' ', 'g')"
    x = f"regexp_replace({x}, '([a-z0-9])\\.(com|org|net|in|fr|co)\\b', '\\1 ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
