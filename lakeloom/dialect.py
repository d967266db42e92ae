"""The SQL dialect's query text as Spark SQL.

Text is cut into tokens and nested groups (what parentheses and brackets hold), and each level is rewritten where Spark spells a thing
otherwise or means something else by it. What both engines share passes through, and Catalyst does the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from lakeloom.functions.scalar import similar_pattern, to_char_text


@dataclass
class Token:
    kind: str  # word, name, text, number, op
    text: str


@dataclass
class Group:
    items: list
    open: str = "("


_LEX = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>[eE]?'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*")|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[A-Za-z_]\w*)|(?P<op>::|\|\||<=|>=|<>|!=|!~\*|!~|~\*|<<|>>|[-+*/%^~\#&|<>=.,;()\[\]?:$@!])""",
    re.S | re.X,
)

# Type names of the dialect and Spark's.
TYPES = {
    "smallint": "SMALLINT", "int2": "SMALLINT", "smallserial": "SMALLINT", "int": "INT", "integer": "INT", "int4": "INT", "serial": "INT", "bigint": "BIGINT", "int8": "BIGINT", "bigserial": "BIGINT", "float": "DOUBLE", "float8": "DOUBLE", "float4": "DOUBLE", "real": "DOUBLE", "double": "DOUBLE",
    "text": "STRING", "varchar": "STRING", "char": "STRING", "character": "STRING", "json": "STRING", "jsonb": "STRING", "uuid": "STRING", "boolean": "BOOLEAN", "bool": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "numeric": "DOUBLE", "decimal": "DOUBLE", "time": "TIME", "string": "STRING", "vector": "ARRAY<FLOAT>",
}
_KEYWORDS = frozenset("select from where group by having order limit offset union intersect except all distinct on using join left right full inner outer cross natural lateral as and or not in is null between like ilike similar to case when then else end with recursive values window over partition rows range groups filter fetch first next row only any some exists escape asc desc nulls last true false symmetric interval cast set returning".split())
_ENDS = frozenset("limit offset fetch union intersect except window rows range groups for returning".split())
_INTS = "('tinyint', 'smallint', 'int', 'bigint')"


def lex(text: str) -> list:
    """Tokens and groups of a text."""
    stack, kinds, at = [[]], [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        kind, value = m.lastgroup, m[0]
        if kind == "space":
            continue
        if value in ("(", "["):
            stack.append([])
            kinds.append(value)
        elif value in (")", "]"):
            if not kinds or {"(": ")", "[": "]"}[kinds[-1]] != value:
                raise SyntaxError("parentheses do not match")
            items = stack.pop()
            stack[-1].append(Group(items, kinds.pop()))
        elif kind == "text" and value[0] in "eE":
            stack[-1].append(Token("text", value[1:]))
        else:
            stack[-1].append(Token(kind, value))
    if kinds:
        raise SyntaxError("parentheses do not match")
    return stack[0]


def show(items: list) -> str:
    out = []
    for x in items:
        if isinstance(x, Group):
            out.append(f"({show(x.items)})" if x.open == "(" else f"[{show(x.items)}]")
        elif x.kind == "name":
            out.append("`" + x.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif x.kind == "text":
            out.append("'" + x.text[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'")
        else:
            out.append(x.text)
    text = " ".join(out)
    return re.sub(r" ?\. ?", ".", text) if " . " in text else text


def word(x, *texts: str) -> bool:
    return isinstance(x, Token) and x.kind == "word" and x.text.lower() in texts


def op(x, *texts: str) -> bool:
    return isinstance(x, Token) and x.kind == "op" and x.text in texts


def raw(text: str) -> Token:
    return Token("sql", text)


def split(items: list, separator: str = ",") -> list[list]:
    """A level cut at commas."""
    parts: list[list] = [[]]
    for x in items:
        if op(x, separator):
            parts.append([])
        else:
            parts[-1].append(x)
    return parts if parts != [[]] else []


def find(items: list, start: int, *texts: str) -> int:
    return next((i for i in range(start, len(items)) if word(items[i], *texts)), -1)


def _is_value(x) -> bool:
    return isinstance(x, Group) or isinstance(x, Token) and (x.kind in ("name", "text", "number", "sql") or x.kind == "word" and x.text.lower() not in _KEYWORDS - {"null", "true", "false", "end"})


def _begin(items: list, end: int) -> int:
    """Where the primary that ends at ``end`` (inclusive) begins."""
    i = end
    while isinstance(items[i], Group) and items[i].open == "[" and i and _is_value(items[i - 1]):
        i -= 1
    if word(items[i], "end"):
        depth = 0
        while i >= 0:
            depth += word(items[i], "end")
            depth -= word(items[i], "case")
            if not depth:
                return i
            i -= 1
        return 0
    if isinstance(items[i], Group) and i and isinstance(items[i - 1], Token) and (items[i - 1].kind == "word" and items[i - 1].text.lower() not in _KEYWORDS - {"cast", "left", "right"} or items[i - 1].kind == "name"):
        i -= 1
    while i >= 2 and op(items[i - 1], "."):
        i -= 2
    return i


def _end(items: list, start: int) -> int:
    """Where the primary that starts at ``start`` ends (exclusive); a sign belongs to it."""
    i = start
    if i < len(items) and op(items[i], "-", "+"):
        i += 1
    if i < len(items) and word(items[i], "case"):
        depth = 0
        while i < len(items):
            depth += word(items[i], "case")
            depth -= word(items[i], "end")
            i += 1
            if not depth:
                return i
    i += 1
    while i + 1 < len(items) and op(items[i], "."):
        i += 2
    while i < len(items) and isinstance(items[i], Group) and not word(items[i - 1], *(_KEYWORDS - {"cast", "left", "right"})):
        i += 1
    return i


def type_of(items: list, i: int) -> tuple[str, int]:
    """Spark's name of the type that starts at ``i``, and where it ends."""
    name = items[i].text.lower()
    i += 1
    known = TYPES.get(name, "STRING" if not isinstance(items[i - 1], Group) else name)
    if name == "double" and i < len(items) and word(items[i], "precision") or name == "character" and i < len(items) and word(items[i], "varying"):
        i += 1
    if i < len(items) and isinstance(items[i], Group) and items[i].open == "(":
        if name in ("numeric", "decimal"):
            known = f"DECIMAL({show(items[i].items)})"
        i += 1
    if name in ("timestamp", "time") and i + 2 < len(items) and word(items[i], "with", "without") and word(items[i + 1], "time"):
        known = {"timestamp": "TIMESTAMP", "time": "TIME"}[name] if word(items[i], "with") else known
        i += 3
    return known, i


def _cast(value: str, kind: str) -> Token:
    if kind.startswith("DECIMAL"):
        return raw(f"CAST(CAST({value} AS {kind}) AS DOUBLE)")
    if kind == "ARRAY<FLOAT>":
        return raw(f"CAST(from_json({value}, 'array<double>') AS ARRAY<FLOAT>)")
    return raw(f"CAST({value} AS {kind})")


_UNITS = {"year": 0, "yr": 0, "y": 0, "month": 1, "mon": 1, "week": 2, "w": 2, "day": 3, "d": 3, "hour": 4, "hr": 4, "h": 4, "minute": 5, "min": 5, "m": 5, "second": 6, "sec": 6, "s": 6}


def interval(text: str) -> str:
    """An interval text such as ``1 year 2 mons 3 days 04:05:06``."""
    parts = [0.0] * 7
    for n, unit, clock in re.findall(r"([-+]?[\d.]+)\s*([a-zA-Z]+)|([-+]?\d+:\d+(?::[\d.]+)?)", text):
        if clock:
            sign = -1 if clock.startswith("-") else 1
            for k, x in enumerate(clock.lstrip("+-").split(":")):
                parts[4 + k] += sign * float(x)
        else:
            parts[_UNITS[unit.lower().rstrip("s") if unit.lower() not in ("s",) else "s"]] += float(n)
    if re.fullmatch(r"\s*[-+]?[\d.]+\s*", text):
        parts[6] = float(text)
    shown = [str(int(x)) for x in parts[:6]] + [f"CAST({parts[6]} AS DECIMAL(18,6))"]
    return f"make_interval({', '.join(shown)})"


_RENAMED = {"strpos": "instr", "random": "rand", "gen_random_uuid": "uuid", "char_length": "length", "ceiling": "ceil", "variance": "var_samp", "stddev": "stddev_samp"}


def _function(name: str, args: list[str], group: Group) -> str | None:
    """A call in Spark's terms, or None if it is spelled alike."""
    if name in _RENAMED:
        return f"{_RENAMED[name]}({', '.join(args)})"
    if name == "concat":
        return f"concat_ws('', {', '.join(args)})"
    if name == "trunc" and args:
        scale = f"power(10.0D, {args[1]})" if len(args) > 1 else "1.0D"
        return f"(IF({args[0]} >= 0, floor({args[0]} * {scale}), ceil({args[0]} * {scale})) / {scale})"
    if name in ("sqrt", "ln"):
        return f"lk_{name}({args[0]})" if _undecided is not None else None
    if name == "sign":
        return f"CAST(signum({args[0]}) AS INT)"
    if name == "age":
        return f"lk_age(CAST({args[0]} AS DATE), CAST({args[1] if len(args) > 1 else 'current_date()'} AS DATE))" if len(args) > 1 else f"lk_age(current_date(), CAST({args[0]} AS DATE))"
    if name == "array_to_string":
        return f"array_join(transform({args[0]}, x -> CAST(x AS STRING)), {', '.join(args[1:])})"
    if name == "format" and args[0].startswith("'"):
        shown = re.sub(r"%(?![sI%])", "%%", args[0])
        kinds = re.findall(r"%([sI])", shown.replace("%%", ""))
        given = [f"quote_ident(CAST({a} AS STRING))" if k == "I" else f"coalesce(CAST({a} AS STRING), '')" for k, a in zip(kinds, args[1:])]
        return f"format_string({', '.join([shown.replace('%I', '%s'), *given])})"
    if name == "to_char" and len(args) == 2 and args[1].startswith("'") and re.search("[A-Za-z]", args[1]):
        return to_char_text(args[0], args[1][1:-1])
    if name == "l2_distance":
        return f"aggregate(zip_with({args[0]}, {args[1]}, (x, y) -> CAST(x - y AS DOUBLE) * CAST(x - y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
    if name == "inner_product":
        return f"(- aggregate(zip_with({args[0]}, {args[1]}, (x, y) -> CAST(x AS DOUBLE) * y), 0.0D, (s, x) -> s + x))"
    if name == "cosine_distance":
        dot = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0.0D, (s, x) -> s + x)"
        norm = f"sqrt({dot.format(args[0], args[0])} * {dot.format(args[1], args[1])})"
        return f"IF({norm} = 0, 1.0D, 1 - {dot.format(*args)} / {norm})"
    if name == "regexp_replace" and len(args) == 3:
        return f"replace({', '.join(args)})"
    if name == "initcap":
        return f"array_join(transform(regexp_extract_all({args[0]}, '[^\\\\s_-]+|[\\\\s_-]+', 0), p -> concat(upper(substring(p, 1, 1)), lower(substring(p, 2)))), '')"
    if name == "date_part":
        return _extract(args[0].strip("'").lower(), args[1])
    if name in ("left", "right"):
        if name == "left":
            return f"substring({args[0]}, 1, IF({args[1]} >= 0, {args[1]}, greatest(length({args[0]}) + {args[1]}, 0)))"
        return f"substring({args[0]}, greatest(IF({args[1]} >= 0, length({args[0]}) - {args[1]}, - ({args[1]})) + 1, 1))"
    if name in ("substring", "substr") and len(args) in (2, 3):
        stop = f"{args[1]} + {args[2]}" if len(args) == 3 else f"length({args[0]}) + 1"
        return f"substring({args[0]}, greatest({args[1]}, 1), greatest({stop} - greatest({args[1]}, 1), 0))"
    return None


def _extract(field: str, value: str) -> str:
    if field == "dow":
        return f"(dayofweek({value}) - 1)"
    if field == "isodow":
        return f"(weekday({value}) + 1)"
    if field == "epoch":
        return f"(unix_micros(CAST({value} AS TIMESTAMP)) / 1000000)"
    if field == "second":
        return f"CAST(extract(SECOND FROM {value}) AS INT)"
    return f"extract({field.upper()} FROM {value})"


def rewrite(items: list) -> list:
    """One level, its groups first."""
    items = _filter_over(items)
    done: list = []
    i = 0
    while i < len(items):
        x = items[i]
        if isinstance(x, Group):
            before = done[-1] if done else None
            name = before.text.lower() if isinstance(before, Token) and before.kind == "word" else ""
            if name == "cast" and (at := find(x.items, 0, "as")) > 0 and x.open == "(":
                kind, _ = type_of(x.items, at + 1)
                done[-1] = _cast(show(rewrite(x.items[:at])), kind)
            elif name == "extract" and (at := find(x.items, 0, "from")) > 0:
                done[-1] = raw(_extract(x.items[0].text.strip("'").lower(), show(rewrite(x.items[at + 1 :]))))
            elif name in ("string_agg", "array_agg") and (at := find(x.items, 0, "order")) > 0:
                args = show(rewrite(x.items[:at]))
                order = show(_orders(rewrite(x.items[at + 2 :])))
                done[-1] = raw(f"string_agg({args}) WITHIN GROUP (ORDER BY {order})") if name == "string_agg" else raw(_array_text(args, order))
            elif name == "array_agg":
                done[-1] = raw(_array_text(show(rewrite(x.items)), None))
            elif name == "array" and x.open == "[":
                done[-1] = raw(f"array({show(rewrite(x.items))})")
            elif name in ("substring",) and (at := find(x.items, 0, "from")) > 0:
                to = find(x.items, 0, "for")
                args = [show(rewrite(x.items[:at])), show(rewrite(x.items[at + 1 : to if to > 0 else None]))] + ([show(rewrite(x.items[to + 1 :]))] if to > 0 else [])
                done[-1] = raw(_function("substring", args, x))
            elif name and name not in _KEYWORDS - {"left", "right"} and x.open == "(" and not (name in ("left", "right") and not split(x.items)):
                made = _function(name, [show(rewrite(p)) for p in split(x.items)], x)
                if made is not None:
                    done[-1] = raw(made)
                else:
                    done.append(Group(rewrite(x.items), x.open))
            else:
                done.append(Group(rewrite(x.items), x.open))
        elif word(x, "interval") and i + 1 < len(items) and isinstance(items[i + 1], Token) and items[i + 1].kind == "text":
            done.append(raw(interval(items[i + 1].text[1:-1])))
            i += 1
        elif op(x, "::"):
            kind, end = type_of(items, i + 1)
            at = _begin(done, len(done) - 1)
            text = done[at].text if at == len(done) - 1 and isinstance(done[at], Token) and done[at].kind == "text" else ""
            name = items[i + 1].text.lower()
            value = interval(text[1:-1]) if name == "interval" else None
            done[at:] = [raw(value) if value else _cast(show(done[at:]), kind)]
            i = end - 1
        elif word(x, "localtime"):
            done.append(raw("current_time()"))
        elif word(x, "localtimestamp") and not (i + 1 < len(items) and isinstance(items[i + 1], Group)):
            done.append(raw("localtimestamp()"))
        elif isinstance(x, Token) and x.kind == "number" and re.search(r"[.eE]", x.text):
            done.append(raw(x.text + "D"))
        elif word(x, "similar") and i + 2 < len(items) and word(items[i + 1], "to"):
            done += [raw("RLIKE"), raw("r'" + similar_pattern(items[i + 2].text[1:-1].replace("''", "'")) + "'")]
            i += 2
        elif op(x, "~", "~*", "!~", "!~*") and done and _is_value(done[-1]):
            end = _end(items, i + 1)
            value = show(rewrite(items[i + 1 : end]))
            done += [raw("NOT RLIKE" if x.text[0] == "!" else "RLIKE"), raw(f"('(?i)' || {value})" if x.text.endswith("*") else value)]
            i = end - 1
        elif op(x, "^"):
            end = _end(items, i + 1)
            at = _begin(done, len(done) - 1)
            done[at:] = [raw(f"power({show(done[at:])}, {show(rewrite(items[i + 1 : end]))})")]
            i = end - 1
        elif op(x, "#"):
            done.append(raw("^"))
        elif word(x, "any", "some", "all") and i + 1 < len(items) and isinstance(items[i + 1], Group) and done and op(done[-1], "=", "<>", "!=", "<", ">", "<=", ">="):
            inner = items[i + 1].items
            operator = done.pop().text
            at = _begin(done, len(done) - 1)
            left = show(done[at:])
            quantifier = "forall" if word(x, "all") else "exists"
            if inner and word(inner[0], "select", "with"):
                done[at:] = [raw(_quantified(left, operator, quantifier == "forall", show(rewrite(inner))))]
            else:
                done[at:] = [raw(f"{quantifier}({show(rewrite(inner))}, v -> {left} {operator} v)")]
            i += 1
        elif word(x, "between") and i + 1 < len(items) and word(items[i + 1], "symmetric"):
            first = _end(items, i + 2)
            second = _end(items, first + 1)
            a, b = show(rewrite(items[i + 2 : first])), show(rewrite(items[first + 1 : second]))
            done.append(raw(f"BETWEEN least({a}, {b}) AND greatest({a}, {b})"))
            i = second - 1
        elif word(x, "fetch") and i + 1 < len(items) and word(items[i + 1], "first", "next"):
            n = "1" if word(items[i + 2], "row", "rows") else show([items[i + 2]])
            done.append(raw(f"LIMIT {n}"))
            i = find(items, i, "only")
        elif word(x, "generate_series") and i + 1 < len(items) and isinstance(items[i + 1], Group):
            args = [show(rewrite(p)) for p in split(items[i + 1].items)]
            i += 1
            alias, column = "generate_series", "generate_series"
            at = i + 1
            if at < len(items) and word(items[at], "as"):
                at += 1
            if at < len(items) and isinstance(items[at], Token) and items[at].kind == "word" and not word(items[at], *_KEYWORDS):
                alias = column = items[at].text
                i = at
                if at + 1 < len(items) and isinstance(items[at + 1], Group):
                    column = show(items[at + 1].items)
                    i = at + 1
            if len(args) == 3 and "interval" not in args[2]:  # a series that leads nowhere is empty
                args = [f"IF(({args[2]} > 0) = ({args[0]} <= {args[1]}), {args[0]}, NULL)", *args[1:]]
            elif len(args) == 2:
                args = [f"IF({args[0]} <= {args[1]}, {args[0]}, NULL)", args[1], "1"]
            done.append(raw(f"(SELECT explode(sequence({', '.join(args)})) AS {column}) AS {alias}"))
        else:
            done.append(x)
        i += 1
    return _distinct_on(_order_by(_divide(done)))


def _quantified(left: str, operator: str, of_all: bool, query: str) -> str:
    """A comparison with all or any rows of a query; unknown where a null on either side leaves it open.

    Equality is IN, which is a join by the value. Spark's NOT IN meets each row with each unless it stands alone, so that is IN with what the
    query's counts tell of nulls. An order holds for all or any if it does for the least or greatest. Only counts and extremes come to one row.
    """
    if operator == "=" and not of_all:
        return f"{left} IN ({query})"
    facts = f"(SELECT struct(count(*) AS n, count(v) AS k, min(v) AS lo, max(v) AS hi) FROM ({query}) AS lk_values(v))"
    if operator in ("<>", "!=") and of_all:
        # Without coalesce the optimizer makes NOT IN of it again.
        return f"(CASE WHEN coalesce({left} IN ({query}), false) THEN false WHEN {facts}.n = 0 THEN true WHEN {facts}.n = {facts}.k AND {left} IS NOT NULL THEN true END)"
    if operator in ("=", "<>", "!="):
        decides = f"({left} {operator} {facts}.lo {'AND' if of_all else 'OR'} {left} {operator} {facts}.hi)"
    else:
        decides = f"({left} {operator} {facts}.{'lo' if (operator[0] == '<') == of_all else 'hi'})"
    empty, decided = ("true", "false") if of_all else ("false", "true")
    return f"(CASE WHEN {facts}.n = 0 THEN {empty} WHEN {decides} = {decided} THEN {decided} WHEN {facts}.n = {facts}.k THEN {decides} END)"


def _array_text(x: str, order: str | None) -> str:
    """ARRAY_AGG as text, nulls kept."""
    if order is None:
        rows = f"transform(collect_list(struct({x} AS v)), s -> coalesce(CAST(s.v AS STRING), 'NULL'))"
    else:
        key = re.sub(r"\s+(ASC|DESC)?\s*NULLS (FIRST|LAST)$", "", order, flags=re.I)
        rows = f"transform(array_sort(collect_list(struct({key} IS NULL AS n, {key} AS k, {x} AS v))), s -> coalesce(CAST(s.v AS STRING), 'NULL'))"
        if re.search(r"\bDESC\b", order, re.I):
            rows = f"reverse({rows})"
    return f"nullif(concat('{{', array_join({rows}, ','), '}}'), '{{}}')"


#: While a text is made for ``settled``: how many divisions it has.
_undecided: list[int] | None = None


def settled(spark: SparkSession, make: Callable[[], str]) -> str:
    """The text that ``make`` builds by ``rewrite``, with each ``/`` decided by its operands' types: between integers it is ``div``, of type BIGINT.

    Each division is analyzed as one of integers first (``x | 0`` is an error for all other types), and those that Spark refuses become plain ones.
    """
    global _undecided
    _undecided = [0]
    try:
        text, count = make(), _undecided[0]
    finally:
        _undecided = None
    for _ in range(count):
        try:
            spark.sql(text)
            break
        except AnalysisException as e:
            places = [x.stopIndex() for x in e.getQueryContext()]
            mark = next((m[1] for p in places if (m := re.match(r"\s*/\*d(\d+)\*/", text[p + 1 :]))), None)
            if mark is None:
                raise
            a = text.index(f" | 0/*d{mark}*/)")
            b = text.index(f" | 0/*d{mark}*/)", a + 1)
            text = text[:a] + ") /" + text[a:b].split(" div", 1)[1] + text[b + len(f" | 0/*d{mark}*/") :]
    return re.sub(r"/\*d\d+\*/", "", text)


def run(spark: SparkSession, text: str) -> DataFrame:
    """The rows of a query of the dialect."""
    install(spark)
    return spark.sql(settled(spark, lambda: translate(text)))


def install(spark: SparkSession) -> None:
    """Functions of the dialect that Spark lacks, as temporary SQL functions, and its depth of recursion."""
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "5000")
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


#: (arguments, type, body) of functions that ``install`` makes.
FUNCTIONS = {
    "lk_sqrt": ("x DOUBLE", "DOUBLE", "IF(x < 0, CAST(raise_error('cannot take square root of a negative number') AS DOUBLE), sqrt(x))"),
    "lk_ln": ("x DOUBLE", "DOUBLE", "IF(x <= 0, CAST(raise_error('cannot take logarithm of zero or a negative number') AS DOUBLE), ln(x))"),
    "quote_ident": ("s STRING", "STRING", """IF(s RLIKE '^[a-z_][a-z0-9_]*$', s, concat('"', replace(s, '"', '""'), '"'))"""),
    "lk_months": ("a DATE, b DATE", "INT", "CAST(floor(months_between(greatest(a, b), least(a, b), false)) AS INT)"),
    "lk_part": ("n INT, sign STRING, name STRING", "STRING", "IF(n = 0, NULL, concat(sign, n, ' ', name, IF(n = 1 AND sign = '', '', 's')))"),
    "lk_age": ("a DATE, b DATE", "STRING", "IF(a IS NULL OR b IS NULL, NULL, coalesce(nullif(concat_ws(' ', lk_part(lk_months(a, b) div 12, IF(a < b, '-', ''), 'year'), lk_part(lk_months(a, b) % 12, IF(a < b, '-', ''), 'mon'), lk_part(datediff(greatest(a, b), add_months(least(a, b), lk_months(a, b))), IF(a < b, '-', ''), 'day')), ''), '00:00:00'))"),
}


def _divide(items: list) -> list:
    """``/`` between integers cuts toward zero. The types decide while the query is analyzed; chains of ``* / %`` go from left to right."""
    if not any(op(x, "/") for x in items):
        return items
    out: list = []
    i = 0
    while i < len(items):
        if op(items[i], "*", "/", "%") and out and _is_value(out[-1]):
            end = _end(items, i + 1)
            at = _begin(out, len(out) - 1)
            a, b = show(out[at:]), show(items[i + 1 : end])
            if op(items[i], "/") and _undecided is not None:
                _undecided[0] += 1
                made = f"(({a} | 0/*d{_undecided[0]}*/) div ({b} | 0/*d{_undecided[0]}*/))"
            elif op(items[i], "/"):
                made = f"IF(typeof({a}) IN {_INTS} AND typeof({b}) IN {_INTS}, CAST({a} AS BIGINT) div CAST({b} AS BIGINT), {a} / {b})"
            else:
                made = f"({a} {items[i].text} {b})"
            out[at:] = [raw(made)]
            i = end
        else:
            out.append(items[i])
            i += 1
    return out


def _filter_over(items: list) -> list:
    """``f(x) FILTER (WHERE c) OVER`` as ``f(CASE WHEN c THEN x END) OVER``; of ``*`` the rows are counted as 1."""
    out: list = []
    for x in items:
        if word(x, "over") and len(out) > 2 and word(out[-2], "filter") and isinstance(out[-1], Group) and isinstance(out[-3], Group) and out[-1].items and word(out[-1].items[0], "where"):
            args = out[-3].items
            if len(split(args)) != 1 or word(args[0], "distinct"):
                raise SyntaxError("FILTER on a window needs an aggregate of one argument without DISTINCT")
            value = raw("1") if len(args) == 1 and op(args[0], "*") else Group(args)
            out[-3:] = [Group([Token("word", "CASE"), Token("word", "WHEN"), Group(out[-1].items[1:]), Token("word", "THEN"), value, Token("word", "END")])]
        out.append(x)
    return out


def _orders(items: list) -> list:
    """Sort keys with the dialect's place of nulls: last ascending, first descending."""
    out: list = []
    for k, part in enumerate(split(items)):
        if k:
            out.append(Token("op", ","))
        out += part
        if find(part, 0, "nulls") < 0:
            out.append(raw("NULLS FIRST" if part and word(part[-1], "desc") else "NULLS LAST"))
    return out


def _order_by(items: list) -> list:
    out: list = []
    i = 0
    while i < len(items):
        if word(items[i], "order") and i + 1 < len(items) and word(items[i + 1], "by"):
            end = next((k for k in range(i + 2, len(items)) if word(items[k], *_ENDS) or isinstance(items[k], Token) and items[k].kind == "sql" and items[k].text.startswith("LIMIT")), len(items))
            out += [*items[i : i + 2], *_orders(items[i + 2 : end])]
            i = end
        else:
            out.append(items[i])
            i += 1
    return out


def _distinct_on(items: list) -> list:
    """SELECT DISTINCT ON (keys) list FROM ..: the rows with row number 1 for the keys in the query's own order."""
    at = next((i for i in range(len(items) - 3) if word(items[i], "select") and word(items[i + 1], "distinct") and word(items[i + 2], "on") and isinstance(items[i + 3], Group)), -1)
    if at < 0:
        return items
    keys = show(items[at + 3].items)
    source = find(items, at, "from")
    order = next((i for i in range(source, len(items)) if word(items[i], "order")), len(items))
    stop = next((i for i in range(order, len(items)) if word(items[i], "limit", "offset") or isinstance(items[i], Token) and items[i].kind == "sql" and items[i].text.startswith("LIMIT")), len(items))
    by = show(items[order + 2 : stop]) or keys
    inner = f"SELECT {show(items[at + 4 : source])}, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS _nth {show(items[source:order])}"
    tail = f" ORDER BY {by}" if order < len(items) else ""
    return [*items[:at], raw(f"SELECT * EXCEPT (_nth) FROM ({inner}) WHERE _nth = 1{tail}"), *items[stop:]]


def translate(text: str) -> str:
    """A query of the dialect as Spark SQL."""
    items = lex(text.strip().rstrip(";"))
    return show(rewrite(items))
