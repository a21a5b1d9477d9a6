"""Pieces of DuckDB SQL with the same fixed values as the operators, for checking results."""

from __future__ import annotations

from boardfoot.functions import vocabulary as V


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lookup(table: dict[str, str], key: str) -> str:
    return f"map([{', '.join(map(quote, table))}], [{', '.join(map(quote, table.values()))}])[{key}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def match(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {quote(pattern)}), false)"


def find(x: str, pattern: str, group: int = 0) -> str:
    return f"CASE WHEN regexp_matches({x}, {quote(pattern)}) THEN regexp_extract({x}, {quote(pattern)}, {group}) END"


def replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"


def title(x: str) -> str:
    return f"list_reduce(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda s: upper(s[1:1]) || lower(s[2:])), lambda a, b: a || b)"


def thickness(x: str) -> str:
    low = f"lower({strip(x)})"
    return f"CASE WHEN {x} <> '' THEN coalesce({lookup(V.THICKNESS, low)}, {find(low, '^[0-9]+/[0-9]+')}, upper({low})) END"


def grade(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN coalesce({lookup(V.GRADES, f'lower({strip(x)})')}, {strip(x)}) END"


def species(x: str) -> str:
    low = replace(f"lower({strip(x)})", ":+$")
    keys = "[" + ", ".join(map(quote, V.SPECIES)) + "]"
    near = f"list_filter({keys}, lambda k: contains(low, k) OR contains(k, low))[1]"
    return f"(SELECT CASE WHEN low <> '' THEN coalesce({lookup(V.SPECIES, 'low')}, {lookup(V.SPECIES, near)}, {title(strip('x'))}) END FROM (SELECT {x} AS x, {low} AS low))"


def has_species_word(x: str) -> str:
    return match(f"lower({x})", "|".join(V.SPECIES_WORDS))


def any_match(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(match(x, p) for p in patterns) + ")"


def candidate_score(x: str) -> str:
    """Over a column that is trimmed already."""
    total = "0e0"
    for w, patterns in V.CANDIDATE_SIGNALS:
        test = " OR ".join(has_species_word(x) if p == V.SPECIES_WORD else match(x, p) for p in patterns)
        total = f"({total} + CASE WHEN {test} THEN {w}e0 ELSE 0e0 END)"
    total = f"(SELECT s + CASE WHEN length({x}) < 8 AND s <= 0 THEN -0.2e0 ELSE 0e0 END FROM (SELECT {total} AS s))"
    return f"CASE WHEN length({x}) >= 3 THEN greatest(0e0, least(1e0, {total})) ELSE 0e0 END"


def row_score(species: str, thickness: str, grade: str, quantity: str, number: str, color: str, raw: str) -> str:
    add = lambda test, w: f" + CASE WHEN {test} THEN {w}e0 ELSE 0e0 END"
    has = lambda x: f"coalesce({x} <> '', false)"
    s = "0e0" + add(has(species), 0.25)
    s += f" + CASE WHEN {match(thickness, '^[0-9]{1,2}/[0-9]$')} THEN 0.3e0 WHEN {has(thickness)} THEN 0.15e0 ELSE 0e0 END" + add(has(grade), 0.2)
    s += f" + CASE WHEN {number} > 0 THEN 0.15e0 WHEN upper({strip(quantity)}) IN ('T/L', 'TL', 'CALL') OR {match(quantity, '[0-9]')} THEN 0.1e0 ELSE 0e0 END" + add(has(color), 0.03)
    for w, p in V.ROW_PENALTIES:
        s += add(match(raw, p), w)
    bare = f"NOT {has(thickness)} AND NOT {has(grade)}"
    rest = strip(replace(raw, r"""[\d,]+['"]?\s*"""))
    s += add(f"NOT {has(species)} AND {bare}", -0.3) + add(bare, -0.15) + add(f"{bare} AND {raw} <> '' AND length({rest}) < 15 AND NOT {match(raw, V.FRACTION)}", -0.2)
    return f"round(greatest(0e0, least(1e0, {s})), 3)"


def classify(x: str) -> str:
    return f"CASE WHEN {x} >= 0.7e0 THEN 'accept' WHEN {x} >= 0.4e0 THEN 'review' ELSE 'reject' END"


def header_text(x: str) -> str:
    return replace(replace(strip(x), ":+$"), r"^[*\- ]+|[*\- ]+$")


def is_species_header(x: str) -> str:
    t = f"upper({header_text(x)})"
    names = "|".join(V.HEADER_NAMES)
    words = "list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')"
    known = "[" + ", ".join(map(quote, V.HEADER_WORDS)) + "]"
    keys = ", ".join(map(quote, V.SPECIES))
    short = f"length(t) < 50 AND NOT regexp_matches(t, '[0-9]') AND len({words}) <= 5 AND list_has_any({words}, {known})"
    return f"(SELECT coalesce(t <> '' AND (lower(t) IN ({keys}) OR regexp_matches(t, {quote(f'^(?:{names})(?: |:|$)')}) OR ({short})), false) FROM (SELECT {t} AS t))"
