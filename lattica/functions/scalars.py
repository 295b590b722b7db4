"""Arithmetic, comparison, logic, strings, types and objects."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import (
    Ctx,
    Ex,
    ExpressionError,
    as_date,
    compare,
    compile_expr,
    element_type,
    expression,
    guard,
    is_null,
    literal,
    named,
    operands,
    root_of,
    truthy,
    wider,
)

_D, _L, _S, _B = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def _null(ctx: Ctx, t: T.DataType | None = None) -> Ex:
    return Ex(F.lit(None) if t is None else F.lit(None).cast(t), t or T.NullType(), ctx)


def _millis(e: Ex):
    return F.unix_millis(as_date(e).col)


# arithmetic


@expression("$add")
def _add(node, ctx):
    es = operands(node, ctx)
    if not es:
        return literal(0, ctx)
    if any(e.kind == "null" for e in es):
        return _null(ctx)
    dates = [e for e in es if e.kind == "date"]
    rest = [e for e in es if e.kind != "date"]
    if len(dates) > 1:
        raise ExpressionError("only one date allowed in an $add expression")
    t = wider(*[e.type for e in rest]) if rest else _L
    total = None
    for e in rest:
        c = e.col.cast(t)
        total = c if total is None else total + c
    if dates:
        shift = F.bround(total).cast("long") if total is not None else F.lit(0)
        return Ex(F.timestamp_millis(_millis(dates[0]) + shift), T.TimestampType(), ctx)
    return Ex(total, None if isinstance(t, T.DecimalType) else t, ctx)


@expression("$subtract")
def _subtract(node, ctx):
    a, b = operands(node, ctx, 2, 2, "$subtract")
    if "null" in (a.kind, b.kind):
        return _null(ctx)
    if a.kind == "date":
        if b.kind == "date":
            return Ex(_millis(a) - _millis(b), _L, ctx)
        return Ex(F.timestamp_millis(_millis(a) - F.bround(b.col).cast("long")), T.TimestampType(), ctx)
    t = wider(a.type, b.type)
    return Ex(a.col.cast(t) - b.col.cast(t), None if isinstance(t, T.DecimalType) else t, ctx)


@expression("$multiply")
def _multiply(node, ctx):
    es = operands(node, ctx)
    if any(e.kind == "null" for e in es):
        return _null(ctx)
    t = wider(*[e.type for e in es]) if es else _L
    out = F.lit(1).cast(t)
    for i, e in enumerate(es):
        out = e.col.cast(t) if not i else out * e.col.cast(t)
    return Ex(out, None if isinstance(t, T.DecimalType) else t, ctx)


@expression("$divide")
def _divide(node, ctx):
    a, b = operands(node, ctx, 2, 2, "$divide")
    if "null" in (a.kind, b.kind):
        return _null(ctx)
    if isinstance(a.type, T.DecimalType) or isinstance(b.type, T.DecimalType):
        return ctx.ex(a.col / guard(b.col != 0, b.col, "can't $divide by zero"))
    x, y = a.col.cast("double"), b.col.cast("double")
    return Ex(x / guard(y != 0, y, "can't $divide by zero"), _D, ctx)


@expression("$mod")
def _mod(node, ctx):
    a, b = operands(node, ctx, 2, 2, "$mod")
    if "null" in (a.kind, b.kind):
        return _null(ctx)
    t = wider(a.type, b.type)
    y = b.col.cast(t)
    return Ex(a.col.cast(t) % guard(y != 0, y, "can't $mod by zero"), None if isinstance(t, T.DecimalType) else t, ctx)


def _unary(name, build, dtype=_D, check=None, message=""):
    @expression(name)
    def f(node, ctx):
        (e,) = operands(node, ctx, 1, 1, name)
        if e.kind == "null":
            return _null(ctx)
        x = e.col.cast("double")
        y = build(x)
        if check is not None:
            y = guard(check(x) | F.isnan(x), y, f"{name}: {message}")
        return Ex(y, dtype, ctx)


_unary("$exp", F.exp)
_unary("$ln", F.log, check=lambda x: x > 0, message="argument must be positive")
_unary("$log10", F.log10, check=lambda x: x > 0, message="argument must be positive")
_unary("$sqrt", F.sqrt, check=lambda x: x >= 0, message="argument must be non-negative")


def _finite(x):
    return F.abs(x) < float("inf")


_unary("$sin", F.sin, check=_finite, message="argument must be finite")
_unary("$cos", F.cos, check=_finite, message="argument must be finite")
_unary("$tan", F.tan, check=_finite, message="argument must be finite")
_unary("$asin", F.asin, check=lambda x: F.abs(x) <= 1, message="argument must lie in [-1, 1]")
_unary("$acos", F.acos, check=lambda x: F.abs(x) <= 1, message="argument must lie in [-1, 1]")
_unary("$atan", F.atan)
_unary("$sinh", F.sinh)
_unary("$cosh", F.cosh)
_unary("$tanh", F.tanh)
_unary("$asinh", F.asinh)
_unary("$acosh", F.acosh, check=lambda x: x >= 1, message="argument must be 1 or more")
_unary("$atanh", F.atanh, check=lambda x: F.abs(x) <= 1, message="argument must lie in [-1, 1]")
_unary("$degreesToRadians", F.radians)
_unary("$radiansToDegrees", F.degrees)


@expression("$atan2")
def _atan2(node, ctx):
    y, x = operands(node, ctx, 2, 2, "$atan2")
    if "null" in (y.kind, x.kind):
        return _null(ctx)
    return Ex(F.atan2(y.col.cast("double"), x.col.cast("double")), _D, ctx)


@expression("$log")
def _log(node, ctx):
    x, b = operands(node, ctx, 2, 2, "$log")
    if "null" in (x.kind, b.kind):
        return _null(ctx)
    n, base = x.col.cast("double"), b.col.cast("double")
    ok = (n > 0) & (base > 0) & (base != 1)
    return Ex(guard(ok, F.log(n) / F.log(base), "$log: argument must be positive and base positive and not 1"), _D, ctx)


@expression("$pow")
def _pow(node, ctx):
    b, e = operands(node, ctx, 2, 2, "$pow")
    if "null" in (b.kind, e.kind):
        return _null(ctx)
    x = guard((b.col != 0) | (e.col >= 0), F.pow(b.col.cast("double"), e.col.cast("double")), "$pow: 0 to a negative exponent")
    whole = all(isinstance(t.type, T.IntegralType) for t in (b, e))
    if whole and e.is_const and e.const >= 0:
        return Ex(x.cast("long"), _L, ctx)
    return Ex(x, _D, ctx)


@expression("$abs")
def _abs(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$abs")
    if e.kind == "null":
        return _null(ctx)
    if isinstance(e.type, T.IntegralType):
        return Ex(F.abs(e.col.cast("long")), _L, ctx)
    return Ex(F.abs(e.col), e.type, ctx)


def _step(name, f):
    @expression(name)
    def g(node, ctx):
        (e,) = operands(node, ctx, 1, 1, name)
        if e.kind == "null":
            return _null(ctx)
        return e if isinstance(e.type, T.IntegralType) else Ex(f(e.col).cast(e.type), e.type, ctx)


_step("$ceil", F.ceil)
_step("$floor", F.floor)


def _places(name, f):
    @expression(name)
    def g(node, ctx):
        es = operands(node, ctx, 1, 2, name)
        e = es[0]
        if any(x.kind == "null" for x in es):
            return _null(ctx)
        place = es[1].const if len(es) > 1 else 0
        if len(es) > 1 and not (es[1].is_const and isinstance(place, int) and -20 <= place <= 100):
            raise ExpressionError(f"{name} takes a constant place between -20 and 100")
        if isinstance(e.type, T.IntegralType) and place >= 0:
            return e
        scale = F.lit(10.0**place)
        out = f(e.col.cast("double") * scale) / scale
        return Ex(out.cast(e.type), e.type, ctx)


_places("$round", F.rint)
_places("$trunc", lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double"))


@expression("$rand")
def _rand(node, ctx):
    return Ex(F.rand(), _D, ctx)


# comparison and logic


def _comparison(name, build):
    @expression(name)
    def f(node, ctx):
        a, b = operands(node, ctx, 2, 2, name)
        return Ex(build(a, b), _B, ctx)


_comparison("$eq", lambda a, b: compare(a, b, "eq"))
_comparison("$ne", lambda a, b: ~compare(a, b, "eq"))
_comparison("$lt", lambda a, b: compare(a, b, "lt"))
_comparison("$lte", lambda a, b: compare(a, b, "lte"))
_comparison("$gt", lambda a, b: compare(b, a, "lt"))
_comparison("$gte", lambda a, b: compare(b, a, "lte"))


@expression("$cmp")
def _cmp(node, ctx):
    a, b = operands(node, ctx, 2, 2, "$cmp")
    out = F.when(compare(a, b, "eq"), 0).when(compare(a, b, "lt"), -1).otherwise(1)
    return Ex(out, T.IntegerType(), ctx)


@expression("$and")
def _and(node, ctx):
    out = F.lit(True)
    for e in operands(node, ctx):
        out = out & truthy(e)
    return Ex(out, _B, ctx)


@expression("$or")
def _or(node, ctx):
    out = F.lit(False)
    for e in operands(node, ctx):
        out = out | truthy(e)
    return Ex(out, _B, ctx)


@expression("$not")
def _not(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$not")
    return Ex(~truthy(e), _B, ctx)


@expression("$cond")
def _cond(node, ctx):
    if isinstance(node, dict):
        e = named(node, ctx, ("if", "then", "else"), name="$cond")
        test, then, other = e["if"], e["then"], e["else"]
    else:
        test, then, other = operands(node, ctx, 3, 3, "$cond")
    return ctx.ex(F.when(truthy(test), then.col).otherwise(other.col))


@expression("$ifNull")
def _if_null(node, ctx):
    return ctx.ex(F.coalesce(*[e.col for e in operands(node, ctx, 2, None, "$ifNull")]))


@expression("$switch")
def _switch(node, ctx):
    branches = node.get("branches") if isinstance(node, dict) else None
    if not branches:
        raise ExpressionError("$switch takes branches")
    out = None
    for b in branches:
        test, then = truthy(compile_expr(b["case"], ctx)), compile_expr(b["then"], ctx).col
        out = F.when(test, then) if out is None else out.when(test, then)
    if "default" in node:
        return ctx.ex(out.otherwise(compile_expr(node["default"], ctx).col))
    return ctx.ex(out.otherwise(F.raise_error(F.lit("$switch found no matching branch and has no default"))))


# strings


def _text(e: Ex):
    """An operand as text, as the case operators and comparisons take it: numbers and dates are spelled out."""
    if e.kind == "date":
        return iso(e)
    return e.col.cast("string")


def iso(e: Ex):
    d = as_date(e).col
    return F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss."), F.lpad((F.unix_millis(d) % 1000).cast("string"), 3, "0"), F.lit("Z"))


@expression("$concat")
def _concat(node, ctx):
    es = operands(node, ctx)
    if any(e.kind == "null" for e in es):
        return _null(ctx, _S)
    if any(e.kind != "string" for e in es):
        raise ExpressionError("$concat only takes strings")
    return Ex(F.concat(*[e.col for e in es]) if es else F.lit(""), _S, ctx)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@expression("$toLower")
def _to_lower(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$toLower")
    return Ex(F.coalesce(F.translate(_text(e), _UPPER, _LOWER), F.lit("")), _S, ctx)


@expression("$toUpper")
def _to_upper(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$toUpper")
    return Ex(F.coalesce(F.translate(_text(e), _LOWER, _UPPER), F.lit("")), _S, ctx)


@expression("$strcasecmp")
def _strcasecmp(node, ctx):
    a, b = operands(node, ctx, 2, 2, "$strcasecmp")
    x, y = (F.translate(F.coalesce(_text(e), F.lit("")), _UPPER, _LOWER) for e in (a, b))
    return Ex(F.when(x < y, -1).when(x > y, 1).otherwise(0), T.IntegerType(), ctx)


@expression("$strLenCP")
def _len_cp(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$strLenCP")
    return Ex(guard(e.col.isNotNull(), F.char_length(e.col), "$strLenCP requires a string"), T.IntegerType(), ctx)


@expression("$strLenBytes")
def _len_bytes(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$strLenBytes")
    return Ex(guard(e.col.isNotNull(), F.octet_length(e.col), "$strLenBytes requires a string"), T.IntegerType(), ctx)


@expression("$substrCP")
def _substr_cp(node, ctx):
    s, start, n = operands(node, ctx, 3, 3, "$substrCP")
    out = F.substring(_text(s), (start.col + 1).cast("int"), n.col.cast("int"))
    out = guard((start.col >= 0) & (n.col >= 0), out, "$substrCP: start and length must be non-negative")
    return Ex(F.coalesce(out, F.lit("")), _S, ctx)


@expression("$substr", "$substrBytes")
def _substr_bytes(node, ctx):
    s, start, n = operands(node, ctx, 3, 3, "$substrBytes")
    body = _text(s).cast("binary")
    size = F.when(n.col < 0, F.octet_length(body)).otherwise(n.col).cast("int")
    out = F.decode(F.substring(body, (start.col + 1).cast("int"), size), "UTF-8")
    return Ex(F.coalesce(guard(start.col >= 0, out, "$substrBytes: start must be non-negative"), F.lit("")), _S, ctx)


@expression("$indexOfCP")
def _index_cp(node, ctx):
    es = operands(node, ctx, 2, 4, "$indexOfCP")
    s, sub = es[0].col, es[1].col
    start = es[2].col if len(es) > 2 else F.lit(0)
    head = s if len(es) < 4 else F.substring(s, F.lit(1), es[3].col.cast("int"))
    at = F.call_function("locate", sub, head, (start + 1).cast("int")) - 1
    return Ex(at, T.IntegerType(), ctx)


@expression("$indexOfBytes")
def _index_bytes(node, ctx):
    es = operands(node, ctx, 2, 4, "$indexOfBytes")
    s, sub = es[0].col, es[1].col
    start = es[2].col.cast("int") if len(es) > 2 else F.lit(0)
    body = s.cast("binary")
    if len(es) > 3:
        body = F.substring(body, F.lit(1), es[3].col.cast("int"))
    rest = F.decode(F.substring(body, start + 1, F.greatest(F.octet_length(body) - start, F.lit(0))), "UTF-8")
    at = F.call_function("locate", sub, rest) - 1
    found = start + F.octet_length(F.substring(rest, F.lit(1), at))
    inside = (start <= F.octet_length(body)) & (at >= 0)
    return Ex(F.when(s.isNull(), F.lit(None)).when(inside, found).otherwise(-1).cast("int"), T.IntegerType(), ctx)


#: What is trimmed by default.
_BLANKS = "\0 \t\n\v\f\r             "


def _ends(name, f):
    @expression(name)
    def g(node, ctx):
        e = named(node, ctx, ("input",), ("chars",), name)
        if e["input"].kind == "null" or e["chars"] is not None and e["chars"].kind == "null":
            return _null(ctx, _S)
        return Ex(f(e["input"].col, e["chars"].col if e["chars"] is not None else F.lit(_BLANKS)), _S, ctx)


_ends("$trim", F.btrim)
_ends("$ltrim", F.ltrim)
_ends("$rtrim", F.rtrim)


@expression("$split")
def _split(node, ctx):
    s, d = operands(node, ctx, 2, 2, "$split")
    if s.kind == "null":
        return _null(ctx, T.ArrayType(_S))
    if d.is_const and d.const == "":
        raise ExpressionError("$split requires a non-empty separator")
    pattern = F.concat(F.lit("\\Q"), d.col, F.lit("\\E"))
    return Ex(F.split(s.col, pattern, -1), T.ArrayType(_S), ctx)


@expression("$replaceAll")
def _replace_all(node, ctx):
    e = named(node, ctx, ("input", "find", "replacement"), name="$replaceAll")
    if any(x.kind == "null" for x in e.values()):
        return _null(ctx, _S)
    return Ex(F.replace(e["input"].col, e["find"].col, e["replacement"].col), _S, ctx)


@expression("$replaceOne")
def _replace_one(node, ctx):
    e = named(node, ctx, ("input", "find", "replacement"), name="$replaceOne")
    if any(x.kind == "null" for x in e.values()):
        return _null(ctx, _S)
    s, f, r = (e[k].col for k in ("input", "find", "replacement"))
    at = F.call_function("locate", f, s)
    rest = F.substring(s, at + F.char_length(f), F.char_length(s))
    return Ex(F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), r, rest)).otherwise(s), _S, ctx)


def _regex(node, ctx, name):
    e = named({k: v for k, v in node.items() if k != "regex"}, ctx, ("input",), ("options",), name)
    pattern, flags = node["regex"], node.get("options") or ""
    if isinstance(pattern, dict) and "$regex" in pattern:
        flags = pattern.get("$options", flags)
        pattern = pattern["$regex"]
    if not isinstance(pattern, str) or pattern.startswith("$"):
        raise ExpressionError(f"{name} takes a constant regex")
    return e["input"], (f"(?{flags})" if flags else "") + pattern


@expression("$regexMatch")
def _regex_match(node, ctx):
    e, pattern = _regex(node, ctx, "$regexMatch")
    return Ex(F.coalesce(F.rlike(e.col, F.lit(pattern)), F.lit(False)) if e.kind != "null" else F.lit(False), _B, ctx)


def _groups(pattern: str) -> int:
    import re

    try:
        return re.compile(pattern).groups
    except re.error:
        return 0


def _match_at(s, pattern: str, offset):
    """{match, idx, captures} of the first match in s, idx counted from offset."""
    p = F.lit(pattern)
    found = F.rlike(s, p)
    whole = F.regexp_extract(s, f"({pattern})" if not pattern.startswith("(?") else pattern, 0)
    at = F.regexp_instr(s, p)
    groups = [F.regexp_extract(s, pattern, i) for i in range(1, _groups(pattern) + 1)]
    caps = F.array(*groups) if groups else F.array().cast("array<string>")
    row = F.struct(whole.alias("match"), (at - 1 + offset).cast("int").alias("idx"), caps.alias("captures"))
    return found, row, whole, at


@expression("$regexFind")
def _regex_find(node, ctx):
    e, pattern = _regex(node, ctx, "$regexFind")
    found, row, *_ = _match_at(e.col.cast("string"), pattern, F.lit(0))
    return ctx.ex(F.when(found, row))


@expression("$regexFindAll")
def _regex_find_all(node, ctx):
    """Positions come from walking the matches in order through the text."""
    e, pattern = _regex(node, ctx, "$regexFindAll")
    s = F.coalesce(e.col.cast("string"), F.lit(""))
    n = _groups(pattern)
    wholes = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    parts = [F.regexp_extract_all(s, F.lit(pattern), F.lit(i)) for i in range(1, n + 1)]
    caps = F.transform(wholes, lambda w, i: F.array(*[F.get(p, i) for p in parts]) if parts else F.array().cast("array<string>"))
    item = "struct<match:string,idx:int,captures:array<string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("out"))

    def add(acc, pair):
        w = pair["w"]
        at = F.call_function("locate", w, s, (acc["at"] + 1).cast("int"))
        at = F.when(F.char_length(w) > 0, at).otherwise(acc["at"] + 1)
        one = F.struct(w.alias("match"), (at - 1).cast("int").alias("idx"), pair["c"].alias("captures"))
        step = F.when(F.char_length(w) > 0, at - 1 + F.char_length(w)).otherwise(acc["at"] + 1)
        return F.struct(step.cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(wholes, caps, lambda w, c: F.struct(w.alias("w"), c.alias("c")))
    return ctx.ex(F.aggregate(pairs, zero, add, lambda acc: acc["out"]))


# objects and variables


@expression("$literal", "$const")
def _literal(node, ctx):
    return literal(node, ctx)


@expression("$let")
def _let(node, ctx):
    found = {k: compile_expr(v, ctx) for k, v in node["vars"].items()}
    return compile_expr(node["in"], ctx.bind(**found))


@expression("$getField")
def _get_field(node, ctx):
    from .core import field_of

    if isinstance(node, dict) and "field" in node:
        name, base = node["field"], compile_expr(node.get("input", "$$CURRENT"), ctx)
    else:
        name, base = node, root_of(ctx)
    if isinstance(name, dict):
        name = name.get("$literal", name.get("$const"))
    return field_of(base, name)


def _set_field(name, value, base, ctx):
    if isinstance(name, dict):
        name = name.get("$literal", name.get("$const"))
    if base.kind == "null":
        return _null(ctx)
    if isinstance(base.type, T.MapType):
        if value is None:
            return ctx.ex(F.map_filter(base.col, lambda k, _: k != name))
        kept = F.map_filter(base.col, lambda k, _: k != name)
        return ctx.ex(F.map_concat(kept, F.create_map(F.lit(name), value.col)))
    fields = base.type.fieldNames()
    cols = [base.col.getField(f).alias(f) for f in fields if f != name]
    if value is not None:
        at = fields.index(name) if name in fields else len(cols)
        cols.insert(at, value.col.alias(name))
    return ctx.ex(F.when(base.col.isNotNull(), F.struct(*cols)))


@expression("$setField")
def _set_field_op(node, ctx):
    value = None if node["value"] == "$$REMOVE" else compile_expr(node["value"], ctx)
    return _set_field(node["field"], value, compile_expr(node["input"], ctx), ctx)


@expression("$unsetField")
def _unset_field(node, ctx):
    return _set_field(node["field"], None, compile_expr(node["input"], ctx), ctx)


@expression("$mergeObjects")
def _merge_objects(node, ctx):
    es = [e for e in operands(node, ctx) if e.kind != "null"]
    if any(e.kind != "object" for e in es):
        raise ExpressionError("$mergeObjects takes documents")
    if es and all(isinstance(e.type, T.MapType) for e in es):
        out = es[0].col
        for e in es[1:]:
            old, new = F.coalesce(out, F.create_map().cast(e.type)), F.coalesce(e.col, F.create_map().cast(e.type))
            out = F.map_concat(F.map_filter(old, lambda k, _, n=new: ~F.map_contains_key(n, k)), new)
        return ctx.ex(out)
    names = list(dict.fromkeys(f for e in es for f in e.type.fieldNames()))
    cols = []
    for n in names:
        having = [e for e in es if n in e.type.fieldNames()]
        value = having[0].col.getField(n)
        for e in having[1:]:
            value = F.when(e.col.isNotNull(), e.col.getField(n)).otherwise(value)
        cols.append(value.alias(n))
    return ctx.ex(F.struct(*cols)) if cols else literal({}, ctx)


@expression("$objectToArray")
def _object_to_array(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$objectToArray")
    if e.kind == "null":
        return _null(ctx)
    if isinstance(e.type, T.MapType):
        return ctx.ex(F.transform(F.map_entries(e.col), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"))))
    items = [F.struct(F.lit(f).alias("k"), e.col.getField(f).alias("v")) for f in e.type.fieldNames()]
    return ctx.ex(F.when(e.col.isNotNull(), F.array(*items)))


@expression("$arrayToObject")
def _array_to_object(node, ctx):
    """A map: keys are data, so they cannot be a struct's fields. The last of equal keys wins."""
    (e,) = operands(node, ctx, 1, 1, "$arrayToObject") if not isinstance(node, list) or len(node) == 1 else (compile_expr(node, ctx),)
    if e.kind == "null":
        return _null(ctx)
    et = element_type(e, "$arrayToObject")
    if isinstance(et, T.ArrayType):
        pair = F.transform(e.col, lambda x: F.struct(F.get(x, F.lit(0)).cast("string").alias("k"), F.get(x, F.lit(1)).alias("v")))
    else:
        pair = F.transform(e.col, lambda x: F.struct(x["k"].cast("string").alias("k"), x["v"].alias("v")))
    last = F.filter(pair, lambda x, i: ~F.exists(F.slice(pair, i + 2, F.size(pair)), lambda y: y["k"] == x["k"]))
    return ctx.ex(F.map_from_entries(last))


@expression("$meta")
def _meta(node, ctx):
    if node == "recordId":
        return Ex(F.monotonically_increasing_id(), _L, ctx)
    return _null(ctx, _D)


# types


def _alias(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int"
    if isinstance(t, T.LongType):
        return "long"
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(t, T.DecimalType):
        return "decimal"
    return {"string": "string", "bool": "bool", "date": "date", "array": "array", "object": "object", "binData": "binData"}.get(Ex(F.lit(0), t).kind, "null")


@expression("$type")
def _type(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$type")
    if isinstance(node, str) and node.startswith("$") and e.kind == "null":
        return literal("missing", ctx)
    return Ex(F.when(is_null(e), "null").otherwise(_alias(e.type)), _S, ctx)


def _is(name, kinds):
    @expression(name)
    def f(node, ctx):
        (e,) = operands([node] if not isinstance(node, list) or name == "$isArray" and len(node) != 1 else node, ctx, 1, 1, name)
        return Ex(e.col.isNotNull() if e.kind in kinds else F.lit(False), _B, ctx)


_is("$isNumber", {"number"})
_is("$isString", {"string"})
_is("$isDate", {"date"})
_is("$isArray", {"array"})


@expression("$isObjectId")
def _is_object_id(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$isObjectId")
    return Ex(F.coalesce(F.octet_length(e.col) == 12, F.lit(False)) if e.kind == "binData" else F.lit(False), _B, ctx)


@expression("$binarySize")
def _binary_size(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$binarySize")
    return Ex(F.octet_length(e.col), T.IntegerType(), ctx)


#: Code and name of the conversion targets.
TARGETS = {1: "double", 2: "string", 5: "binData", 7: "objectId", 8: "bool", 9: "date", 16: "int", 18: "long", 19: "decimal"}
_CAST = {"double": "double", "int": "int", "long": "bigint", "decimal": "decimal(38,10)"}


def _convert(e: Ex, to: str, ctx: Ctx, strict: bool) -> Ex:
    """The conversion; where it fails null, or an error if ``strict``."""
    k, t = e.kind, None

    def done(col, dtype):
        if strict:
            bad = is_null(Ex(col, dtype, ctx)) & ~is_null(e)
            col = F.when(bad, F.raise_error(F.concat(F.lit(f"failed to convert to {to}: "), e.col.cast("string")))).otherwise(col)
        return Ex(col, dtype, ctx)

    if k == "null":
        return e
    if to == "bool":
        return Ex(e.col if k == "bool" else F.when(e.col.isNotNull(), truthy(e) if k == "number" else F.lit(True)), _B, ctx)
    if to == "string":
        col = iso(e) if k == "date" else F.lower(F.hex(e.col)) if k == "binData" else F.concat(e.col.cast("string"))
        return Ex(col, _S, ctx)
    if to == "date":
        if k == "date":
            return as_date(e)
        t = T.TimestampType()
        if k == "number":
            return Ex(F.timestamp_millis(e.col.cast("long")), t, ctx)
        if k == "string":
            return done(e.col.try_cast("timestamp"), t)
        if k == "binData":
            return Ex(F.timestamp_seconds(F.conv(F.hex(F.substring(e.col, 1, 4)), 16, 10).cast("long")), t, ctx)
    if to == "objectId":
        return done(F.when(F.rlike(e.col, F.lit("^[0-9a-fA-F]{24}$")), F.unhex(e.col)), T.BinaryType()) if k == "string" else e
    if to == "binData":
        return done(F.try_to_binary(e.col, F.lit("base64")), T.BinaryType()) if k == "string" else e
    if to in _CAST:
        target = T._parse_datatype_string(_CAST[to])
        if k == "date":
            return Ex(_millis(e).cast(target), target, ctx)
        if k == "bool":
            return Ex(e.col.cast("int").cast(target), target, ctx)
        if k == "number":
            if to in ("int", "long") and not isinstance(e.type, T.IntegralType):
                whole = F.when(e.col >= 0, F.floor(e.col)).otherwise(F.ceil(e.col))
                return done(whole.try_cast(target), target)
            return done(e.col.try_cast(target), target)
        if k == "string":
            shape = "^[+-]?[0-9]+$" if to in ("int", "long") else "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(Infinity|NaN)$"
            return done(F.when(F.rlike(e.col, F.lit(shape)), e.col.try_cast(target)), target)
    if strict:
        raise ExpressionError(f"no conversion from {k} to {to}")
    return Ex(F.lit(None).cast("string"), _S, ctx)


@expression("$convert")
def _convert_op(node, ctx):
    e = compile_expr(node["input"], ctx)
    to = node["to"]
    to = to.get("type", to) if isinstance(to, dict) else to
    to = TARGETS.get(to, to)
    if to not in TARGETS.values():
        raise ExpressionError(f"$convert: unknown target {to}")
    out = _convert(e, to, ctx, "onError" not in node)
    col = out.col
    if "onError" in node:
        col = F.coalesce(col, F.when(~is_null(e), compile_expr(node["onError"], ctx).col))
    if "onNull" in node:
        col = F.when(is_null(e), compile_expr(node["onNull"], ctx).col).otherwise(col)
    return ctx.ex(col)


def _to(name, target):
    @expression(name)
    def f(node, ctx):
        (e,) = operands(node, ctx, 1, 1, name)
        return _convert(e, target, ctx, True)


for _name, _target in {
    "$toBool": "bool", "$toDate": "date", "$toDecimal": "decimal", "$toDouble": "double", "$toInt": "int",
    "$toLong": "long", "$toObjectId": "objectId", "$toString": "string",
}.items():
    _to(_name, _target)


@expression("$toUUID")
def _to_uuid(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$toUUID")
    return Ex(F.unhex(F.replace(e.col, F.lit("-"), F.lit(""))), T.BinaryType(), ctx)


@expression("$bsonSize")
def _bson_size(node, ctx):
    """Bytes of a document in the wire format, summed over its static shape."""
    e = compile_expr(node, ctx)
    if e.kind == "null":
        return _null(ctx)
    return Ex(F.when(e.col.isNotNull(), _size_of(e)).cast("int"), T.IntegerType(), ctx)


def _size_of(e: Ex):
    """Bytes of a value: fixed widths, or lengths with their headers."""
    t, c = e.type, e.col
    if isinstance(t, T.StructType):
        total = F.lit(5)
        for f in t.fields:
            inner = Ex(c.getField(f.name), f.dataType, e.ctx)
            total = total + F.lit(2 + len(f.name.encode())) + F.coalesce(_size_of(inner), F.lit(0))
        return F.coalesce(F.when(c.isNotNull(), total), F.lit(0))
    if isinstance(t, T.ArrayType):
        each = F.transform(c, lambda x, i: F.lit(2) + F.char_length(i.cast("string")) + F.coalesce(_size_of(Ex(x, t.elementType, e.ctx)), F.lit(0)))
        return F.coalesce(F.aggregate(each, F.lit(5), lambda a, x: a + x.cast("int")), F.lit(0))
    if e.kind == "string":
        return F.coalesce(F.octet_length(c) + 5, F.lit(0))
    if e.kind == "binData":
        return F.coalesce(F.octet_length(c) + 5, F.lit(0))
    width = 4 if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)) else 16 if isinstance(t, T.DecimalType) else 1 if e.kind == "bool" else 8
    return F.when(c.isNotNull(), F.lit(width)).otherwise(F.lit(0))


@expression("$tsSecond")
def _ts_second(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$tsSecond")
    return Ex(F.shiftrightunsigned(e.col, 32), _L, ctx)


@expression("$tsIncrement")
def _ts_increment(node, ctx):
    (e,) = operands(node, ctx, 1, 1, "$tsIncrement")
    return Ex(e.col.bitwiseAND(F.lit(0xFFFFFFFF)), _L, ctx)

