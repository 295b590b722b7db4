"""Date operators. Dates are TIMESTAMP; the session's zone is UTC, ``timezone`` shifts to local time."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import Ex, ExpressionError, as_date, compile_expr, expression, is_null

_I, _L, _S, _TS = T.IntegerType(), T.LongType(), T.StringType(), T.TimestampType()
UNITS = ["year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond"]
#: Milliseconds of the units of fixed length.
MILLIS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}
#: First days of a week, by their number with Sunday as 1.
WEEK_STARTS = {"sunday": 1, "monday": 2, "tuesday": 3, "wednesday": 4, "thursday": 5, "friday": 6, "saturday": 7}


def _zone(node, ctx):
    if node is None:
        return None
    e = compile_expr(node, ctx)
    if e.is_const and isinstance(e.const, str):
        z = e.const
        if re.fullmatch(r"[+-]\d{2}", z):
            z += ":00"
        elif re.fullmatch(r"[+-]\d{4}", z):
            z = z[:3] + ":" + z[3:]
        return None if z in ("UTC", "GMT", "Z") else F.lit(z)
    return e.col


def local(d: Ex, zone):
    """The date whose UTC fields are the local ones."""
    c = as_date(d).col
    return c if zone is None else F.from_utc_timestamp(c, zone)


def back(c, zone):
    return c if zone is None else F.to_utc_timestamp(c, zone)


def _date_operand(node, ctx):
    if isinstance(node, list) and len(node) == 1:
        node = node[0]
    if isinstance(node, dict) and "date" in node:
        return compile_expr(node["date"], ctx), _zone(node.get("timezone"), ctx)
    return compile_expr(node, ctx), None


def _part(name, build, dtype=_I):
    @expression(name)
    def f(node, ctx):
        d, zone = _date_operand(node, ctx)
        if d.kind == "null":
            return Ex(F.lit(None).cast(dtype), dtype, ctx)
        return Ex(build(local(d, zone)).cast(dtype), dtype, ctx)


def week_of(d):
    """Weeks from Sunday; days before the first Sunday are in week 0."""
    return F.floor((F.dayofyear(d) - F.dayofweek(d) + 7) / 7).cast("int")


def iso_year(d):
    return F.extract(F.lit("YEAROFWEEK"), d)


_part("$year", F.year)
_part("$month", F.month)
_part("$dayOfMonth", F.dayofmonth)
_part("$dayOfWeek", F.dayofweek)
_part("$dayOfYear", F.dayofyear)
_part("$hour", F.hour)
_part("$minute", F.minute)
_part("$second", F.second)
_part("$millisecond", lambda d: F.pmod(F.unix_millis(d), F.lit(1000)))
_part("$week", week_of)
_part("$isoWeek", F.weekofyear)
_part("$isoWeekYear", iso_year, _L)
_part("$isoDayOfWeek", lambda d: F.weekday(d) + 1)


def _unit(node, ctx, name):
    unit = node["unit"]
    if unit not in UNITS:
        raise ExpressionError(f"{name}: unknown unit {unit}")
    return unit


def _shift(name, sign):
    @expression(name)
    def f(node, ctx):
        d, n = compile_expr(node["startDate"], ctx), compile_expr(node["amount"], ctx)
        if "null" in (d.kind, n.kind):
            return Ex(F.lit(None).cast(_TS), _TS, ctx)
        unit, zone = _unit(node, ctx, name), _zone(node.get("timezone"), ctx)
        amount = n.col.cast("int") * sign
        return Ex(back(F.timestamp_add(unit.upper(), amount, local(d, zone)), zone) if unit != "millisecond"
                  else F.timestamp_millis(F.unix_millis(as_date(d).col) + amount), _TS, ctx)


_shift("$dateAdd", 1)
_shift("$dateSubtract", -1)


def _week_start(node):
    name = (node.get("startOfWeek") or "sunday").lower()
    full = [w for w in WEEK_STARTS if w.startswith(name)] if len(name) >= 3 else []
    if len(full) != 1:
        raise ExpressionError(f"unknown day of the week {name}")
    return WEEK_STARTS[full[0]]


def _months(d):
    return F.year(d) * 12 + F.month(d) - 1


def _days(d):
    return F.unix_date(d.cast("date"))


@expression("$dateDiff")
def _date_diff(node, ctx):
    """Unit boundaries between the dates, not whole units passed."""
    a, b = compile_expr(node["startDate"], ctx), compile_expr(node["endDate"], ctx)
    if "null" in (a.kind, b.kind):
        return Ex(F.lit(None).cast(_L), _L, ctx)
    unit, zone = _unit(node, ctx, "$dateDiff"), _zone(node.get("timezone"), ctx)
    x, y = local(a, zone), local(b, zone)
    if unit == "year":
        out = F.year(y) - F.year(x)
    elif unit == "quarter":
        out = F.floor(_months(y) / 3) - F.floor(_months(x) / 3)
    elif unit == "month":
        out = _months(y) - _months(x)
    elif unit == "day":
        out = _days(y) - _days(x)
    elif unit == "week":
        # 1970-01-01 was a Thursday: day numbers are moved so that a week starts at a multiple of 7
        move = (12 - _week_start(node)) % 7
        out = F.floor((_days(y) + move) / 7) - F.floor((_days(x) + move) / 7)
    else:
        ms = MILLIS[unit]
        out = F.floor(F.unix_millis(y) / ms) - F.floor(F.unix_millis(x) / ms)
    return Ex(out.cast("long"), _L, ctx)


@expression("$dateTrunc")
def _date_trunc(node, ctx):
    """The start of the date's bin; bins of several units are counted from 2000-01-01."""
    d = compile_expr(node["date"], ctx)
    if d.kind == "null":
        return Ex(F.lit(None).cast(_TS), _TS, ctx)
    unit, zone, size = _unit(node, ctx, "$dateTrunc"), _zone(node.get("timezone"), ctx), node.get("binSize", 1)
    x = local(d, zone)
    if unit in ("year", "quarter", "month"):
        width = size * {"year": 12, "quarter": 3, "month": 1}[unit]
        at = F.floor((_months(x) - 2000 * 12) / width) * width + 2000 * 12
        out = F.make_timestamp(F.floor(at / 12).cast("int"), (at % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    else:
        ms = MILLIS[unit] * size
        base = 946_684_800_000  # 2000-01-01, a Saturday
        if unit == "week":
            base += ((_week_start(node) - 7) % 7) * MILLIS["day"]
        out = F.timestamp_millis(F.floor((F.unix_millis(x) - base) / ms) * ms + base)
    return Ex(back(out, zone), _TS, ctx)


@expression("$dateFromParts")
def _from_parts(node, ctx):
    """Parts out of range carry over into the next larger one."""
    zone = _zone(node.get("timezone"), ctx)

    def part(name, default):
        return compile_expr(node[name], ctx).col.cast("long") if name in node else F.lit(default).cast("long")

    if "isoWeekYear" in node:
        first = F.make_date(part("isoWeekYear", 1970).cast("int"), F.lit(1), F.lit(4))
        monday = F.unix_date(first) - F.weekday(first)
        days = monday + (part("isoWeek", 1) - 1) * 7 + part("isoDayOfWeek", 1) - 1
    else:
        months = part("year", 1970) * 12 + part("month", 1) - 1
        first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
        days = F.unix_date(first) + part("day", 1) - 1
    ms = days * MILLIS["day"] + part("hour", 0) * MILLIS["hour"] + part("minute", 0) * MILLIS["minute"]
    ms = ms + part("second", 0) * 1000 + part("millisecond", 0)
    return Ex(back(F.timestamp_millis(ms), zone), _TS, ctx)


@expression("$dateToParts")
def _to_parts(node, ctx):
    d, zone = compile_expr(node["date"], ctx), _zone(node.get("timezone"), ctx)
    x = local(d, zone)
    if node.get("iso8601"):
        parts = {"isoWeekYear": iso_year(x), "isoWeek": F.weekofyear(x), "isoDayOfWeek": F.weekday(x) + 1}
    else:
        parts = {"year": F.year(x), "month": F.month(x), "day": F.dayofmonth(x)}
    parts |= {"hour": F.hour(x), "minute": F.minute(x), "second": F.second(x), "millisecond": F.pmod(F.unix_millis(x), F.lit(1000))}
    return ctx.ex(F.when(~is_null(d), F.struct(*[v.cast("int").alias(k) for k, v in parts.items()])))


#: Format letters and the date pattern each stands for.
_PARSE = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "L": "SSS", "b": "MMM", "B": "MMMM", "j": "DDD", "z": "xx", "%": "'%'"}


@expression("$dateFromString")
def _from_string(node, ctx):
    s = compile_expr(node["dateString"], ctx)
    zone = _zone(node.get("timezone"), ctx)
    if s.kind == "null":
        out = F.lit(None).cast(_TS)
    elif "format" in node:
        pattern = re.sub(r"%(.)|([A-Za-z]+)", lambda m: _PARSE[m[1]] if m[1] else f"'{m[2]}'", node["format"])
        out = F.try_to_timestamp(s.col, F.lit(pattern))
    else:
        out = s.col.try_cast("timestamp")
    out = back(out, zone)
    if "onError" in node:
        out = F.coalesce(out, F.when(s.col.isNotNull(), as_date(compile_expr(node["onError"], ctx)).col))
    else:
        out = F.when(out.isNull() & s.col.isNotNull(), F.raise_error(F.concat(F.lit("cannot parse the date "), s.col))).otherwise(out)
    if "onNull" in node:
        out = F.when(s.col.isNull(), as_date(compile_expr(node["onNull"], ctx)).col).otherwise(out)
    return Ex(out, _TS, ctx)


def _padded(c, n):
    return F.lpad(c.cast("string"), n, "0")


def _year(c):
    """Four digits at least; years that need more, or a sign, are written whole (``lpad`` would cut them)."""
    return F.when((c < 0) | (c > 9999), c.cast("string")).otherwise(_padded(c, 4))


def _offset(x, utc):
    """Minutes that local time is ahead."""
    return ((F.unix_millis(x) - F.unix_millis(utc)) / 60_000).cast("int")


@expression("$dateToString")
def _to_string(node, ctx):
    d, zone = compile_expr(node["date"], ctx), _zone(node.get("timezone"), ctx)
    form = node.get("format", "%Y-%m-%dT%H:%M:%S.%LZ" if zone is None else "%Y-%m-%dT%H:%M:%S.%L")
    if d.kind == "null":
        out = F.lit(None).cast(_S)
    else:
        x = local(d, zone)
        off = _offset(x, as_date(d).col)
        sign = F.when(off < 0, "-").otherwise("+")
        parts = {
            "Y": lambda: _year(F.year(x)), "m": lambda: _padded(F.month(x), 2), "d": lambda: _padded(F.dayofmonth(x), 2),
            "H": lambda: _padded(F.hour(x), 2), "M": lambda: _padded(F.minute(x), 2), "S": lambda: _padded(F.second(x), 2),
            "L": lambda: _padded(F.pmod(F.unix_millis(x), F.lit(1000)), 3), "j": lambda: _padded(F.dayofyear(x), 3),
            "w": lambda: F.dayofweek(x).cast("string"), "u": lambda: (F.weekday(x) + 1).cast("string"), "U": lambda: _padded(week_of(x), 2),
            "V": lambda: _padded(F.weekofyear(x), 2), "G": lambda: _year(iso_year(x)), "b": lambda: F.date_format(x, "MMM"),
            "B": lambda: F.date_format(x, "MMMM"), "Z": lambda: off.cast("string"),
            "z": lambda: F.concat(sign, _padded(F.floor(F.abs(off) / 60), 2), _padded(F.abs(off) % 60, 2)), "%": lambda: F.lit("%"),
        }
        pieces = []
        for m in re.finditer(r"%(.)|([^%]+)", form):
            if m[1] and m[1] not in parts:
                raise ExpressionError(f"$dateToString: unknown format %{m[1]}")
            pieces.append(parts[m[1]]() if m[1] else F.lit(m[2]))
        out = F.concat(*pieces) if pieces else F.lit("")
    if "onNull" in node:
        out = F.when(is_null(d), compile_expr(node["onNull"], ctx).col).otherwise(out)
    return Ex(out, _S, ctx)


def of_unit(c, unit: str, n):
    """A date moved by n units."""
    if unit == "millisecond":
        return F.timestamp_millis(F.unix_millis(c) + n)
    return F.timestamp_add(unit.upper(), n, c)


