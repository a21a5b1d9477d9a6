"""Text helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space at either end; what a pattern calls white space, at less cost than a pattern."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def filled(x: Column) -> Column:
    """Null if empty."""
    return F.nullif(x, F.lit(""))


def title(x: Column) -> Column:
    """Each run of letters with a capital first and small letters after."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))), "")


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(x: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))  # with a column for x, or `let`


def lookup(table: dict[str, str], key: Column) -> Column:
    """A fixed table's value, or null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, key)


def any_match(x: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the patterns is found. Patterns of one case mode are one alternation."""
    plain = [p for p in patterns if not p.startswith("(?i)")]
    loose = [p.removeprefix("(?i)") for p in patterns if p.startswith("(?i)")]
    tests = [x.rlike("|".join(f"(?:{p})" for p in plain))] if plain else []
    tests += [x.rlike("(?i)" + "|".join(f"(?:{p})" for p in loose))] if loose else []
    return tests[0] | tests[1] if len(tests) == 2 else tests[0]
