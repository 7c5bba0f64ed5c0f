"""The English stemmer as DuckDB SQL, for the queries' SQL: a chain of common table expressions over distinct words."""

from __future__ import annotations

from quill.functions import stem as P

_V = "[aeiouy]"
_C = "[^aeiouy]"


def _ends(word: str, suffixes) -> str:
    """The longest of the suffixes that word ends in; empty if none."""
    return f"regexp_extract({word}, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 1)"


def _cut(word: str, suffix: str) -> str:
    return f"left({word}, (length({word}) - length({suffix}))::INT)"


def _case(pairs: dict[str, str], value: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " END"


def _short(word: str) -> str:
    return f"(regexp_matches({word}, '{_C}{_V}[^aeiouywxY]$') OR regexp_full_match({word}, '{_V}{_C}'))"


def stems(source: str, name: str = "stems") -> str:
    """CTEs that end in name(word, lexeme) for the words of the relation source(word)."""
    first = f"regexp_extract({{}}, '^.*?{_V}{_C}')"
    reach = lambda text, whole: f"(CASE WHEN {first.format(text)} = '' THEN {whole} ELSE length({first.format(text)}) END)"
    head = "regexp_extract(x, '^(gener|commun|arsen)', 1)"
    listed = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
    doubles = f"right(y, 2) IN ({listed(P._DOUBLE)})"
    inside = "length(x) - length(s) >= r1"
    step2 = f"CASE s WHEN 'ogi' THEN CASE WHEN substr(x, length(x) - 3, 1) = 'l' THEN left(x, -1) ELSE x END WHEN 'li' THEN CASE WHEN length(x) > 2 AND substr(x, length(x) - 2, 1) IN ({listed('cdeghkmnrt')}) THEN left(x, -2) ELSE x END ELSE {_cut('x', 's')} || {_case(P._STEP2, 's')} END"
    step3 = f"CASE WHEN s <> 'ative' THEN {_cut('x', 's')} || {_case(P._STEP3, 's')} WHEN length(x) - length(s) >= r2 THEN {_cut('x', 's')} ELSE x END"
    bare = _cut("x", "s")
    e_gone = "length(x) - 1 >= r2 OR length(x) - 1 >= r1 AND NOT " + _short("left(x, -1)")
    return f"""
    {name}_a AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '({_V})y', '\\1Y', 'g') AS x, length(word) <= 2 OR regexp_matches(word, '[^\\x00-\\x7F]') OR word IN ({listed(P._INVARIANT | set(P._SPECIAL))}) AS fixed FROM {source}),
    {name}_b AS (SELECT *, CASE WHEN {head} <> '' THEN length({head}) ELSE {reach('x', 'length(x)')} END AS r1 FROM {name}_a),
    {name}_c AS (SELECT *, r1 + {reach('substr(x, (r1 + 1)::INT)', 'length(x) - r1')} AS r2 FROM {name}_b),
    {name}_d AS (SELECT * REPLACE (CASE WHEN x LIKE '%sses' THEN left(x, -2) WHEN x LIKE '%ied' OR x LIKE '%ies' THEN CASE WHEN length(x) > 4 THEN left(x, -2) ELSE left(x, -1) END
        WHEN x LIKE '%s' AND x NOT LIKE '%us' AND x NOT LIKE '%ss' AND regexp_matches(left(x, -1), '{_V}.') AND regexp_matches(left(x, -2), '{_V}') THEN left(x, -1) ELSE x END AS x) FROM {name}_c),
    {name}_e AS (SELECT *, x IN ({listed(P._AFTER_1A)}) AS done, {_ends('x', ('eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'))} AS s FROM {name}_d),
    {name}_f AS (SELECT *, {bare} AS y FROM {name}_e),
    {name}_g AS (SELECT * REPLACE (CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN {inside} THEN y || 'ee' ELSE x END WHEN s <> '' AND regexp_matches(y, '{_V}') THEN
        CASE WHEN right(y, 2) IN ('at', 'bl', 'iz') THEN y || 'e' WHEN {doubles} THEN left(y, -1) WHEN {_short('y')} AND r1 >= length(y) THEN y || 'e' ELSE y END ELSE x END AS x) FROM {name}_f),
    {name}_h AS (SELECT * REPLACE (CASE WHEN length(x) > 2 AND regexp_matches(x, '{_C}[yY]$') THEN left(x, -1) || 'i' ELSE x END AS x) FROM {name}_g),
    {name}_i AS (SELECT * REPLACE ({_ends('x', (*P._STEP2, 'ogi', 'li'))} AS s) FROM {name}_h),
    {name}_j AS (SELECT * REPLACE (CASE WHEN s <> '' AND {inside} THEN {step2} ELSE x END AS x) FROM {name}_i),
    {name}_k AS (SELECT * REPLACE ({_ends('x', (*P._STEP3, 'ative'))} AS s) FROM {name}_j),
    {name}_l AS (SELECT * REPLACE (CASE WHEN s <> '' AND {inside} THEN {step3} ELSE x END AS x) FROM {name}_k),
    {name}_m AS (SELECT * REPLACE ({_ends('x', (*P._STEP4, 'ion'))} AS s) FROM {name}_l),
    {name}_n AS (SELECT * REPLACE (CASE WHEN s <> '' AND length(x) - length(s) >= r2 AND (s <> 'ion' OR length(x) > 3 AND substr(x, length(x) - 3, 1) IN ('s', 't')) THEN {bare} ELSE x END AS x) FROM {name}_m),
    {name}_o AS (SELECT * REPLACE (CASE WHEN x LIKE '%e' AND ({e_gone}) THEN left(x, -1) WHEN x LIKE '%ll' AND length(x) - 1 >= r2 THEN left(x, -1) ELSE x END AS x) FROM {name}_n),
    {name} AS (SELECT word, CASE WHEN fixed THEN coalesce({_case(P._SPECIAL, 'word')}, word) WHEN done THEN replace(y0, 'Y', 'y') ELSE replace(x, 'Y', 'y') END AS lexeme FROM (SELECT o.*, d.x AS y0 FROM {name}_o o JOIN {name}_d d USING (word)))"""
