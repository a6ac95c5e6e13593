"""The functions that a program can call: what they take, what they give, and the column they are.

Every one is a built-in expression, so all of them stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmap.errors import Refusal
from weftmap.types import BOOL, DATE, DATETIME, FLOAT, INTEGER, LANG, STRING, YEAR, sequence


@dataclass(frozen=True)
class Function:
    params: tuple[tuple[str, object], ...]
    result: object
    column: Callable[..., Column]
    aggregate: bool = False
    constant: frozenset[int] = frozenset()  # positions that take a literal


def _text(value) -> str:
    """A literal argument as plain text."""
    if not isinstance(value, str):
        raise Refusal("unsupported/expression", "this argument must be a string literal")
    return value


def slug(text: Column) -> Column:
    """Lower case; whatever is no letter, digit, dot or dash becomes a dash of its own; dashes at the ends go."""
    spaced = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}.-]", "-")
    return F.regexp_replace(spaced, "^-+|-+$", "")


# What counts as markup, with possessive groups so that an unclosed tag is read once.
MARKUP = r"""<(?:>|$|[^\s](?:"[^"]*"|'[^']*'|[^>"']++)*+(?:>|$))"""


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, MARKUP, "")


def split(text: Column, separator) -> Column:
    """A literal separator; an empty one gives the text's characters."""
    by = _text(separator)
    return F.split(text, r"\Q" + by.replace(r"\E", r"\E\\E\Q") + r"\E" if by else "", -1)


# Directives of strptime and the letters that Spark writes for them.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "j": "DDD", "z": "Z",
}
#: Directives that take one digit or two.
LENIENT = {"m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s"}


def date_pattern(form: str) -> str:
    """A strptime format as a pattern of Spark's; an unknown directive is refused."""
    out, i, plain = [], 0, ""

    def flush():
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c in "'#{}[]" for c in plain) else plain)
        plain = ""

    while i < len(form):
        if form[i] == "%":
            i += 1
            if form[i : i + 1] == "%":
                plain += "%"
            elif form[i : i + 1] in DIRECTIVES:
                flush()
                out.append(LENIENT.get(form[i], DIRECTIVES[form[i]]))
            else:
                raise Refusal("unsupported/expression", f"the directive %{form[i : i + 1]} is not known")
        else:
            plain += form[i]
        i += 1
    flush()
    return "".join(out)


def as_date(text: Column, form) -> Column:
    return F.to_date(text, date_pattern(_text(form)))


def as_datetime(text: Column, form) -> Column:
    return F.to_timestamp_ntz(text, F.lit(date_pattern(_text(form))))


def half_away(value: Column) -> Column:
    return F.round(value.cast("double")).cast("bigint")


# The catalogue. A `str` function is also a method of its first argument.
FUNCTIONS: dict[str, Function] = {
    "str.length": Function((("text", STRING),), INTEGER, lambda t: F.length(t).cast("bigint")),
    "str.slice": Function((("text", STRING), ("start", INTEGER)), STRING, lambda t, s: F.substr(t, s.cast("int"))),
    "str.contains": Function((("text", STRING), ("part", STRING)), BOOL, F.contains),
    "str.starts_with": Function((("text", STRING), ("part", STRING)), BOOL, F.startswith),
    "str.ends_with": Function((("text", STRING), ("part", STRING)), BOOL, F.endswith),
    "str.matches": Function((("text", STRING), ("pattern", STRING)), BOOL, F.rlike),
    "str.replace": Function((("text", STRING), ("part", STRING), ("by", STRING)), STRING, F.replace),
    "str.split": Function((("text", STRING), ("separator", STRING)), sequence(STRING), split, constant=frozenset({1})),
    "str.trim": Function((("text", STRING),), STRING, F.trim),
    "str.lower": Function((("text", STRING),), STRING, F.lower),
    "str.upper": Function((("text", STRING),), STRING, F.upper),
    "str.lang": Function((("text", STRING), ("tag", STRING)), LANG, lambda t, g: F.when(t.isNotNull(), F.struct(t.alias("value"), g.alias("lang")))),
    "str.slug": Function((("text", STRING),), STRING, slug),
    "str.strip_html": Function((("text", STRING),), STRING, strip_html),
    "parse.integer": Function((("text", STRING),), INTEGER, lambda t: t.cast("bigint")),
    "parse.float": Function((("text", STRING),), FLOAT, lambda t: t.cast("double")),
    "parse.date": Function((("text", STRING), ("format", STRING)), DATE, as_date, constant=frozenset({1})),
    "parse.datetime": Function((("text", STRING), ("format", STRING)), DATETIME, as_datetime, constant=frozenset({1})),
    "parse.year": Function((("text", STRING),), YEAR, lambda t: t.cast("int")),
    "math.sum": Function((("value", FLOAT),), FLOAT, F.sum, aggregate=True),
    "math.avg": Function((("value", FLOAT),), FLOAT, F.avg, aggregate=True),
    "math.min": Function((("value", FLOAT),), FLOAT, F.min, aggregate=True),
    "math.max": Function((("value", FLOAT),), FLOAT, F.max, aggregate=True),
    "math.abs": Function((("value", FLOAT),), FLOAT, F.abs),
    "math.round": Function((("value", FLOAT),), INTEGER, half_away),
}
