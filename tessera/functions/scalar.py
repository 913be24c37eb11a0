"""Typed columns: operators, functions and casts where the dialect's results differ from Spark's."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import TypeMismatch, Unsupported
from tessera.functions import temporal as M
from tessera.types import FLOATS, INTS, NUMBERS, Type

BOOL, INT8, FLOAT8, NUMERIC, TEXT, NULL = map(Type, ("bool", "int8", "float8", "numeric", "text", "null"))
#: No character of a pattern escapes; this one can't occur in text that is typed.
NO_ESCAPE = "\u0001"
WHOLE = "decimal(19,0)"
#: NUMERIC with a digit less before the point, so that a sum of two keeps all places.
STEP = "decimal(37,18)"


@dataclass(frozen=True)
class Expr:
    """A column with the dialect's type; ``name`` is what it is called when selected without alias."""

    col: Column
    type: Type
    name: str = "?column?"


def null(t: Type) -> Column:
    return F.lit(None).cast(t.spark() if t.kind != "null" else "void")


def literal(v: object) -> Expr:
    if v is None:
        return Expr(F.lit(None), NULL)
    if isinstance(v, bool):
        return Expr(F.lit(v), BOOL)
    if isinstance(v, int):
        return Expr(F.lit(v).cast("long"), INT8)
    return Expr(F.lit(v).cast("double"), FLOAT8) if isinstance(v, float) else Expr(F.lit(v), TEXT)


def typed_literal(kind: str, text: str) -> Expr:
    """DATE '…' and the like, judged when the statement is bound."""
    if kind == "DATE":
        return Expr(F.lit(M.date(text)), Type("date"))
    if kind == "TIMESTAMPTZ":
        return Expr(F.timestamp_micros(F.lit(M.micros_of(M.timestamp(text))).cast("long")), Type("timestamptz"))
    if kind == "TIME":
        return Expr(F.lit(M.time(text)).cast("long"), Type("time"))
    if kind == "INTERVAL":
        return Expr(M.interval_lit(M.interval(text)), Type("interval"))
    if kind == "UUID":
        import uuid

        try:
            return Expr(F.lit(str(uuid.UUID(text.strip()))), Type("uuid"))
        except ValueError:
            raise TypeMismatch(f"not a uuid: {text!r}") from None
    try:
        return Expr(F.lit(str(Decimal(text.strip()))).cast(NUMERIC.spark()), NUMERIC)
    except InvalidOperation:
        raise TypeMismatch(f"not a number: {text!r}") from None


# text forms


def float_text(c: Column, t: Type) -> Column:
    """Shortest digits without exponent; 5 rather than 5.0."""
    s = c.cast("string")
    large = F.when(F.abs(c) < 1e38, s.try_cast("decimal(38,0)").cast("string"))
    small = F.rtrim(s.try_cast("decimal(38,37)").cast("string"), F.lit("0"))
    plain = F.regexp_replace(s, r"\.0$", "")
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(~s.contains("E"), plain).when(F.abs(c) >= 1, F.coalesce(large, s)).otherwise(F.coalesce(small, s))


def numeric_text(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)


def text_of(e: Expr) -> Column:
    k, c = e.type.kind, e.col
    if k in ("text", "uuid", "json"):
        return c
    if k == "bool":
        return F.when(c, "t").when(~c, "f")
    if k in FLOATS:
        return float_text(c, e.type)
    if k == "numeric":
        return numeric_text(c)
    if k == "bytea":
        return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    if k == "timestamptz":
        return M.timestamp_text(c)
    if k == "time":
        return M.clock(c)
    if k == "interval":
        return M.interval_text(c)
    if k == "array":
        inner = F.transform(c, lambda x: F.coalesce(text_of(Expr(x, e.type.elem)), F.lit("NULL")))
        return F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))
    return c.cast("string")


# comparison and arithmetic


def common(types: list[Type], what: str) -> Type:
    """The one type that values of all these can be brought to without a cast."""
    known = [t for t in dict.fromkeys(types) if t != NULL]
    if not known:
        return NULL
    if len(known) == 1:
        return known[0]
    if all(t.kind in NUMBERS for t in known):
        kinds = {t.kind for t in known}
        if kinds & set(FLOATS):
            return FLOAT8
        return NUMERIC if "numeric" in kinds else max(known, key=lambda t: INTS.index(t.kind))
    if all(t.kind == "array" for t in known):
        return Type("array", common([t.elem for t in known], what))
    if {t.kind for t in known} == {"timestamp", "timestamptz"}:
        return Type("timestamptz")
    raise TypeMismatch(f"{what}: {' and '.join(map(str, known))}")


def to(e: Expr, t: Type) -> Column:
    if e.type == t:
        return e.col
    if e.type == NULL:
        return null(t)
    return e.col.cast(t.spark())


def sortable(e: Expr) -> Column:
    return M.interval_key(e.col) if e.type.kind == "interval" else e.col


def compare(op: str, a: Expr, b: Expr) -> Expr:
    try:
        t = common([a.type, b.type], f"{op} between")
    except TypeMismatch:
        if op not in ("=", "<>"):
            raise
        # values of unrelated types are never equal
        return Expr(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "<>")), BOOL)
    if t == NULL:
        return Expr(F.lit(None).cast("boolean"), BOOL)
    if op not in ("=", "<>") and t.kind in ("bytea", "json"):
        raise TypeMismatch(f"{op} between {t}")
    x, y = (sortable(Expr(to(e, t), t)) for e in (a, b))
    made = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Expr(made, BOOL)


def boolean(e: Expr, what: str) -> Column:
    if e.type == NULL:
        return F.lit(None).cast("boolean")
    if e.type != BOOL:
        raise TypeMismatch(f"{what} of {e.type}")
    return e.col


def logic(op: str, a: Expr, b: Expr) -> Expr:
    x, y = boolean(a, op), boolean(b, op)
    return Expr(x & y if op == "AND" else x | y, BOOL)


def exact(op: str, x: Column, y: Column) -> Column:
    """Decimals of 18 places: sums, differences and remainders exact, products and quotients rounded in the last place.

    Spark keeps 6 places of a product or quotient of such decimals, so both are made of steps whose results fit.
    Quotients by 10^9 or more keep Spark's places.
    """
    x, y = x.cast(STEP), y.cast(STEP)
    if op in "+-%":
        return {"+": lambda: x + y, "-": lambda: x - y, "%": lambda: x % y}[op]()
    whole = lambda p, q: F.call_function("div", p, q)
    add = lambda *terms: reduce(lambda p, q: (p + q).cast(STEP), (t.cast(STEP) for t in terms))
    if op == "*":
        fraction = lambda v: (v % F.lit(Decimal(1))).cast("decimal(18,18)")
        ten = F.lit(Decimal(10**10))

        def cross(w: Column, f: Column) -> Column:
            # the upper digits of w times f, of which ten places are gone, and the lower ones
            return add(whole(w, ten).cast("decimal(9,0)") * (f * ten).cast("decimal(18,8)"), (w % ten).cast("decimal(10,0)") * f)

        b, d = fraction(x), fraction(y)
        a, c = (x - b).cast(WHOLE), (y - d).cast(WHOLE)
        return add(a * c, cross(a, d), cross(c, b), b * d)
    nine, low = F.lit(Decimal(10**9)), "decimal(27,18)"
    first = (x % y).cast(low) * nine
    second = (first % y).cast(low) * nine
    sign = F.when((x < 0) == (y < 0), 1).otherwise(-1)
    last = whole(second, y) + F.when(F.abs(second % y).cast(low) * 2 >= F.abs(y), sign).otherwise(0)
    made = add(whole(x, y).cast(WHOLE), whole(first, y).cast("decimal(10,0)") * F.lit(Decimal("0.000000001")), last.cast("decimal(10,0)") * F.lit(Decimal("0.000000000000000001")))
    return F.when(F.abs(y) < nine, made).otherwise((x / y).cast(STEP))


def arithmetic(op: str, a: Expr, b: Expr) -> Expr:
    kinds = {t.kind for t in (a.type, b.type) if t != NULL}
    if any(k not in NUMBERS for k in kinds):
        raise TypeMismatch(f"{op} between {a.type} and {b.type}")
    if not kinds:
        return Expr(F.lit(None).cast("long"), INT8)
    if kinds & set(FLOATS):
        if op == "%":
            raise TypeMismatch("% of floating-point numbers")
        t, x, y = FLOAT8, to(a, FLOAT8), to(b, FLOAT8)
    elif "numeric" in kinds:
        t = NUMERIC
        return Expr(exact(op, *(e.col.cast(WHOLE) if e.type.kind in INTS else to(e, NUMERIC) for e in (a, b))).cast(NUMERIC.spark()), NUMERIC)
    else:
        t, x, y = INT8, to(a, INT8), to(b, INT8)
        if op == "/":
            return Expr(F.call_function("div", x, y), INT8)
    made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[op]()
    return Expr(made, t)


def negate(e: Expr) -> Expr:
    if e.type != NULL and e.type.kind not in (*NUMBERS,):
        raise TypeMismatch(f"- of {e.type}")
    return Expr(-e.col, e.type) if e.type != NULL else e


def concat(a: Expr, b: Expr) -> Expr:
    for e in (a, b):
        if e.type.kind in ("bytea", "json"):
            raise TypeMismatch(f"|| of {e.type}")
    return Expr(F.concat(*[null(TEXT) if e.type == NULL else text_of(e) for e in (a, b)]), TEXT)


def like(e: Expr, pattern: Expr) -> Expr:
    for x in (e, pattern):
        if x.type not in (TEXT, NULL):
            raise TypeMismatch(f"LIKE of {x.type}")
    return Expr(F.call_function("like", to(e, TEXT), to(pattern, TEXT), F.lit(NO_ESCAPE)), BOOL)


# functions


def need(e: Expr, kinds: tuple[str, ...], what: str) -> Column:
    if e.type == NULL:
        return null(Type(kinds[0]))
    if e.type.kind not in kinds:
        raise TypeMismatch(f"{what} of {e.type}")
    return e.col


def rounded(name: str, e: Expr) -> Expr:
    c = need(e, ("float8", *NUMBERS), name)
    if e.type.kind in INTS or e.type == NULL:
        return Expr(c, FLOAT8 if e.type == NULL else e.type)
    f = {"ROUND": F.bround if e.type == NUMERIC else F.round, "CEIL": F.ceil, "FLOOR": F.floor}[name]
    if e.type == NUMERIC:
        return Expr(f(c).cast(NUMERIC.spark()), NUMERIC)
    # beyond 2^53 every value is whole, and Spark's results are longs
    return Expr(F.when(F.abs(c) < 2.0**53, f(c).cast(e.type.spark())).otherwise(c), e.type)


def extreme(name: str, args: list[Expr]) -> Expr:
    t = common([a.type for a in args], name)
    if len(args) == 1 or t == NULL:
        return Expr(args[0].col, t)
    cols = [to(a, t) for a in args]
    if t.kind == "interval":
        pick = (lambda x, y: M.interval_key(x) >= M.interval_key(y)) if name == "GREATEST" else (lambda x, y: M.interval_key(x) <= M.interval_key(y))
        return Expr(reduce(lambda x, y: F.when(x.isNull(), y).when(y.isNull() | pick(x, y), x).otherwise(y), cols), t)
    return Expr((F.greatest if name == "GREATEST" else F.least)(*cols), t)


def substring(s: Expr, start: Expr | None, length: Expr | None) -> Expr:
    """Characters from ``start`` on, counted from 1, that lie in the text; a start before it uses up length."""
    c = need(s, ("text",), "SUBSTRING")
    a = F.lit(1).cast("decimal(38,0)") if start is None else need(start, ("int8", *INTS), "SUBSTRING start").cast("decimal(38,0)")
    n = F.lit((1 << 63) - 1).cast("decimal(38,0)") if length is None else need(length, ("int8", *INTS), "SUBSTRING length").cast("decimal(38,0)")
    end = F.least(a + n, F.lit(2**31 - 2).cast("decimal(38,0)"))
    begin = F.greatest(a, F.lit(1).cast("decimal(38,0)"))
    made = F.when(end <= begin, F.lit("")).otherwise(F.substring(c, F.least(begin, F.lit(2**31 - 2)).cast("int"), (end - begin).cast("int")))
    return Expr(F.when(c.isNotNull() & a.isNotNull() & n.isNotNull(), made), TEXT)


def call(name: str, args: list[Expr]) -> Expr:
    n = len(args)

    def arity(*allowed: int) -> None:
        if n not in allowed:
            raise Unsupported(f"{name} with {n} arguments")

    if name == "ABS":
        arity(1)
        return Expr(F.abs(need(args[0], ("float8", *NUMBERS), name)), args[0].type if args[0].type != NULL else FLOAT8)
    if name in ("ROUND", "CEIL", "CEILING", "FLOOR"):
        arity(1)
        return rounded("CEIL" if name == "CEILING" else name, args[0])
    if name == "COALESCE":
        if not n:
            raise Unsupported("COALESCE without arguments")
        t = common([a.type for a in args], name)
        return Expr(F.coalesce(*[to(a, t) for a in args]), t)
    if name == "NULLIF":
        arity(2)
        return Expr(F.when(F.coalesce(compare("=", *args).col, F.lit(False)), null(args[0].type)).otherwise(args[0].col), args[0].type)
    if name in ("GREATEST", "LEAST") and n or name in ("MAX", "MIN") and n >= 2:
        return extreme({"MAX": "GREATEST", "MIN": "LEAST"}.get(name, name), args)
    if name == "CONCAT":
        for a in args:
            if a.type.kind in ("bytea", "json"):
                raise TypeMismatch(f"CONCAT of {a.type}")
        return Expr(F.concat_ws("", *[text_of(a) for a in args if a.type != NULL]) if args else F.lit(""), TEXT)
    if name in ("LENGTH", "CHAR_LENGTH", "CHARACTER_LENGTH"):
        arity(1)
        return Expr(F.char_length(need(args[0], ("text",), name)).cast("long"), INT8)
    if name == "REPEAT":
        arity(2)
        times = F.least(need(args[1], ("int8", *INTS), name), F.lit(2**31 - 1)).cast("int")
        return Expr(F.repeat(need(args[0], ("text",), name), F.greatest(times, F.lit(0))), TEXT)
    if name in ("UPPER", "UCASE", "LOWER", "LCASE"):
        arity(1)
        return Expr((F.upper if name[0] == "U" else F.lower)(need(args[0], ("text",), name)), TEXT)
    if name.startswith("TRIM "):
        f = {"BOTH": F.trim, "LEADING": F.ltrim, "TRAILING": F.rtrim}[name[5:]]
        return Expr(f(need(args[0], ("text",), "TRIM"), need(args[1], ("text",), "TRIM")), TEXT)
    raise Unsupported(f"function {name}")


# casts


def fail(text: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"not {what}: "), F.coalesce(text, F.lit("null"))))


def checked(e: Column, made: Column, what: str) -> Column:
    """``made``; an error where it is null though there was a value."""
    return F.when(e.isNull() | made.isNotNull(), made).otherwise(fail(e.cast("string"), what).cast("void"))


def strip(c: Column) -> Column:
    """Text without white space at its ends, of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cast(e: Expr, t: Type) -> Expr:
    k, s, c = t.kind, e.type.kind, e.col
    no = TypeMismatch(f"CAST of {e.type} as {t}")
    if s == "null":
        return Expr(null(t), t)
    if k == "array":
        if s != "array":
            raise no
        return e
    if s == k:
        return e
    if k == "text":
        return Expr(text_of(e), t)
    if k == "bool":
        if s in INTS:
            return Expr(c != 0, t)
        if s != "text":
            raise no
        w = F.lower(strip(c))
        return Expr(F.when(w.isin("true", "t", "yes", "y", "on", "1"), True).when(w.isin("false", "f", "no", "n", "off", "0"), False).when(c.isNotNull(), fail(c, "a boolean").cast("boolean")), t)
    if k in INTS:
        if s in INTS or s == "bool":
            return Expr(c.cast(t.spark()), t)
        if s in FLOATS:
            return Expr(F.round(c.cast("double")).cast(t.spark()), t)
        if s == "numeric":
            return Expr(F.bround(c, 0).cast(t.spark()), t)
        if s != "text":
            raise no
        return Expr(checked(c, F.when(strip(c).rlike(r"^[+-]?[0-9]+$"), strip(c).try_cast(t.spark())), "an integer"), t)
    if k in FLOATS or k == "numeric":
        if s in NUMBERS:
            return Expr(c.cast(t.spark()), t)
        if s != "text":
            raise no
        return Expr(checked(c, strip(c).try_cast(t.spark()), "a number"), t)
    if k == "bytea" and s == "text":
        return Expr(F.encode(c, "UTF-8"), t)
    if k == "date":
        if s == "timestamptz":
            return Expr(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(c) / M.DAY).cast("int")), t)
        if s in ("timestamp", "text"):
            return Expr(c.cast("date") if s == "timestamp" else checked(c, F.when(strip(c).rlike(r"^\d{4}-\d\d-\d\d$"), strip(c).try_cast("date")), "a date"), t)
    if k == "timestamptz":
        if s == "date":
            return Expr(F.timestamp_micros(F.unix_date(c).cast("long") * M.DAY), t)
        if s in ("text", "timestamp"):
            w = strip(c.cast("string"))
            zoned = F.when(w.rlike(r"([+-]\d\d(:?\d\d)?|[zZ])$") & w.contains(":"), w).when(w.contains(":"), F.concat(w, F.lit("+00:00"))).otherwise(F.concat(w, F.lit(" 00:00:00+00:00")))
            return Expr(checked(c, zoned.try_cast("timestamp"), "a timestamp"), t)
    if k == "time" and s == "text":
        w = strip(c)
        p = F.split(F.regexp_replace(w, r"\..*$", ""), ":")
        part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("long"), F.lit(0))
        fraction = F.rpad(F.coalesce(F.regexp_extract(w, r"\.(\d{1,6})$", 1), F.lit("")), 6, "0").try_cast("long")
        return Expr(checked(c, F.when(w.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$"), (part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000 + fraction), "a time"), t)
    if k == "uuid" and s == "text":
        w = F.lower(F.regexp_replace(strip(c), r"[-{}]", ""))
        parts = [F.substring(w, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return Expr(checked(c, F.when(w.rlike(r"^[0-9a-f]{32}$"), F.concat_ws("-", *parts)), "a uuid"), t)
    if k == "json" and s == "text":
        return Expr(F.to_json(F.parse_json(c)), t)
    raise no


def assign(e: Expr, t: Type) -> Column:
    """A value for a column of an INSERT: fewer coercions than CAST."""
    s, k = e.type.kind, t.kind
    if s == "null":
        return null(t)
    if s == k and k != "array":
        return e.col
    if s in INTS and k in NUMBERS or s in FLOATS and k in FLOATS or s == "numeric" and k in FLOATS:
        return e.col.cast(t.spark())
    if s == k == "array":
        made = F.transform(e.col, lambda x: assign(Expr(x, e.type.elem), t.elem)).cast(t.spark())
        return F.when(F.exists(made, lambda x: x.isNull()), F.raise_error(F.lit("an array element is null")).cast(t.spark())).otherwise(made)
    raise TypeMismatch(f"a value of {e.type} for a column of {t}")
