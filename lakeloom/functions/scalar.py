"""Column expressions with the dialect's semantics. All of them stay in generated JVM code; none is a Python function per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- numbers ---


def int_div(a, b) -> Column:
    """Integer division that cuts toward zero; division by zero raises."""
    return F.call_function("div", _c(a).cast("long"), _c(b).cast("long"))


def trunc_num(x, n: int = 0) -> Column:
    """``x`` cut toward zero after ``n`` digits."""
    scaled = _c(x) * F.lit(10.0**n)
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("double") / F.lit(10.0**n)


def round_half_away(x, n: int = 0) -> Column:
    return F.round(_c(x), n)


def cast_round_int(x) -> Column:
    """A float as an integer, rounded (half away from zero) as a cast of a literal does."""
    return F.round(_c(x), 0).cast("int")


def sqrt_strict(x) -> Column:
    """Square root; a negative argument raises."""
    return F.when(_c(x) < 0, F.raise_error(F.lit("cannot take square root of a negative number")).cast("double")).otherwise(F.sqrt(_c(x)))


def ln_strict(x) -> Column:
    """Natural logarithm; zero and negative arguments raise."""
    return F.when(_c(x) <= 0, F.raise_error(F.lit("cannot take logarithm of zero or a negative number")).cast("double")).otherwise(F.ln(_c(x)))


def sign_int(x) -> Column:
    return F.signum(_c(x)).cast("int")


def between_symmetric(x, a, b) -> Column:
    return _c(x).between(F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


# --- text ---


def concat_skip_null(*parts) -> Column:
    """Texts joined, nulls left out."""
    return F.concat_ws("", *[_c(p).cast("string") for p in parts])


def left(s, n: int) -> Column:
    """The first ``n`` characters; a negative ``n`` leaves out the last ones."""
    s = _c(s)
    return F.substring(s, F.lit(1), F.lit(n)) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s, n: int) -> Column:
    """The last ``n`` characters; a negative ``n`` leaves out the first ones."""
    s = _c(s)
    if n >= 0:
        return F.when(F.length(s) <= n, s).otherwise(F.substring(s, F.length(s) - n + 1, F.lit(n)))
    return F.substring(s, F.lit(1 - n), F.length(s))


def substring(s, start: int, length: int | None = None) -> Column:
    """Characters from ``start`` (from 1); positions before the text use up the length."""
    s = _c(s)
    stop = F.lit(start + length) if length is not None else F.length(s) + 1
    first = max(start, 1)
    return F.substring(s, F.lit(first), F.greatest(stop - first, F.lit(0)))


def initcap(s) -> Column:
    """Each word's first letter in upper case, the rest in lower case; words end at white space, ``-`` and ``_``."""
    pieces = F.regexp_extract_all(_c(s), F.lit(r"[^\s_-]+|[\s_-]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, F.lit(1), F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def format_text(pattern: str, *args) -> Column:
    """``%s`` replaced by the arguments in turn, null as nothing."""
    return F.format_string(re.sub(r"%(?!s)", "%%", pattern), *[F.coalesce(_c(a).cast("string"), F.lit("")) for a in args])


def quote_ident(s) -> Column:
    """An identifier, quoted where it must be."""
    s = _c(s)
    return F.when(s.rlike("^[a-z_][a-z0-9_]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def similar_pattern(pattern: str) -> str:
    """A SIMILAR TO pattern as an anchored regular expression: ``%`` and ``_`` are wildcards, the other metacharacters stay."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": "(?s:.*)", "_": "(?s:.)"}.get(c, "\\" + c if c in ".^$" else c))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def similar_to(s, pattern: str) -> Column:
    return _c(s).rlike(similar_pattern(pattern))


def regex_match(s, pattern: str, ignore_case: bool = False) -> Column:
    """The ``~`` and ``~*`` operators."""
    return _c(s).rlike(("(?i)" if ignore_case else "") + pattern)


def replace_literal(s, search: str, by: str) -> Column:
    """All places of a literal text replaced."""
    return F.replace(_c(s), F.lit(search), F.lit(by)) if search else _c(s)


# Picture names of TO_CHAR and the date patterns they stand for.
_PICTURES = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "MON": "MMM", "MONTH": "MMMM", "DY": "EEE", "DAY": "EEEE", "AM": "a", "PM": "a", "DDD": "D", "Q": "Q"}


def to_char(x, picture: str) -> Column:
    """A date or timestamp by a picture such as ``YYYY-MM-DD HH24:MI:SS``; month and day names in the case the picture has."""
    parts = re.findall("|".join(sorted(_PICTURES, key=len, reverse=True)) + r"|[^A-Za-z]+|[A-Za-z]", picture, re.I)
    made = []
    for p in parts:
        known = _PICTURES.get(p.upper())
        if known is None:
            made.append(F.lit(p))
            continue
        value = F.date_format(_c(x), known)
        made.append(F.upper(value) if p.isupper() and p.upper() in ("MON", "MONTH", "DY", "DAY") else F.lower(value) if p.islower() and p.upper() in ("MON", "MONTH", "DY", "DAY") else value)
    return F.concat(*made)


def to_char_text(x: str, picture: str) -> str:
    """``to_char`` of an expression in SQL text, as SQL text."""
    parts = re.findall("|".join(sorted(_PICTURES, key=len, reverse=True)) + r"|[^A-Za-z]+|[A-Za-z]", picture, re.I)
    made = []
    for p in parts:
        known = _PICTURES.get(p.upper())
        named = p.upper() in ("MON", "MONTH", "DY", "DAY")
        value = f"date_format({x}, '{known}')"
        made.append(f"'{p}'" if known is None else f"upper({value})" if named and p.isupper() else f"lower({value})" if named and p.islower() else value)
    return f"concat({', '.join(made)})"


# --- dates ---


def dow(x) -> Column:
    """Day of the week, Sunday 0."""
    return F.dayofweek(_c(x)) - 1


def epoch(x) -> Column:
    """Seconds since 1970."""
    return F.unix_micros(_c(x).cast("timestamp")).cast("double") / 1e6


def week_plain(x) -> Column:
    """The week of the year counted from January 1, as ``(day of year - 1) / 7 + 1``."""
    return (F.floor((F.dayofyear(_c(x)) - 1) / 7) + 1).cast("int")


def age_text(a, b) -> Column:
    """The calendar distance of two dates as ``N years N mons N days``, parts that are 0 left out."""
    a, b = _c(a).cast("date"), _c(b).cast("date")
    late, early = F.greatest(a, b), F.least(a, b)
    months = F.floor(F.months_between(F.date_add(late, 0), early, False)).cast("int")
    days = F.datediff(late, F.add_months(early, months))
    sign = F.when(a < b, F.lit("-")).otherwise(F.lit(""))

    def part(n: Column, one: str, many: str) -> Column:
        return F.when(n != 0, F.concat(sign, n.cast("string"), F.lit(" "), F.when((n == 1) & (a >= b), F.lit(one)).otherwise(F.lit(many))))

    years = F.floor(months / 12).cast("int")
    text = F.concat_ws(" ", part(years, "year", "years"), part(months % 12, "mon", "mons"), part(days, "day", "days"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.when(text == "", F.lit("00:00:00")).otherwise(text))


# --- arrays as the right side of ANY and ALL ---


def any_of(x, op: str, values: list) -> Column:
    return F.exists(F.array(*[F.lit(v) for v in values]), lambda v: _compare(_c(x), op, v))


def all_of(x, op: str, values: list) -> Column:
    return F.forall(F.array(*[F.lit(v) for v in values]), lambda v: _compare(_c(x), op, v))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"=": lambda: a == b, "<>": lambda: a != b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def enum_order(x, labels: list[str]) -> Column:
    """The ordinal of an enum label, from 1; a text that is no label gives null."""
    place = F.array_position(F.array(*[F.lit(v) for v in labels]), _c(x))
    return F.when(place > 0, place)


def pg_order(x, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """A sort key with the dialect's default: nulls last ascending, first descending."""
    first = descending if nulls_first is None else nulls_first
    c = _c(x)
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last())
