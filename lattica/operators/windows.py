"""``$setWindowFields``: window functions over partitions.

Frames are explicit: without one an operator sees its whole partition. Range
frames over a date use real time (the offset's unit counts). ``$derivative``
and ``$integral`` go by position unless a unit is given.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import Ctx, ExpressionError, as_date, compile_expr
from ..functions.dates import MILLIS
from .accumulators import Order, accumulate, sort_keys

_RANKING = {"$documentNumber", "$rank", "$denseRank", "$shift", "$locf", "$linearFill", "$expMovingAvg", "$derivative", "$integral", "$covariancePop", "$covarianceSamp"}


def _bound(x: Any, low: bool, scale: int = 1) -> int:
    if x == "unbounded":
        return Window.unboundedPreceding if low else Window.unboundedFollowing
    if x == "current":
        return 0
    return int(x * scale)


def _number(e) -> Column:
    """The sort value as a number: dates as milliseconds."""
    return F.unix_millis(as_date(e).col) if e.kind == "date" else e.col


def set_window_fields(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    ctx = Ctx(df)
    order: Order = [(k, 1 if v > 0 else -1) for k, v in (spec.get("sortBy") or {}).items()]
    part = "__part"
    df = df.withColumn(part, compile_expr(spec["partitionBy"], ctx).col if spec.get("partitionBy") is not None else F.lit(0))
    ctx = Ctx(df)
    whole = Window.partitionBy(part)
    keys = sort_keys(ctx, order)
    ordered = whole.orderBy(*keys) if keys else whole
    steps: dict[str, str] = {}
    for i, (name, step) in enumerate(_steps(spec["output"], ctx, order, ordered)):
        df = df.withColumn(f"__step{i}", step)
        steps[name] = f"__step{i}"
    for name, node in spec["output"].items():
        if order and "$expMovingAvg" in node:
            steps[name] = f"__step{len(steps)}"
            df = _moving_average(df, node["$expMovingAvg"], order, part, steps[name])
    ctx = Ctx(df)
    out: dict[str, Column] = {}
    for name, node in spec["output"].items():
        node = dict(node)
        frame = node.pop("window", None)
        ((op, operand),) = node.items()
        if op in _RANKING:
            if not order and op not in ("$covariancePop", "$covarianceSamp"):
                raise ExpressionError(f"{op} requires sortBy")
            out[name] = _ranking(op, operand, ctx, order, whole, ordered, frame, steps.get(name))
        else:
            w = _frame(frame, ctx, order, whole, ordered)
            out[name] = accumulate({op: operand}, ctx, order or None, lambda c, w=w: c.over(w))
    from .rows import set_fields

    return set_fields(df, out).drop(part, *steps.values())


def _moving_average(df: DataFrame, operand: dict[str, Any], order: Order, part: str, to: str) -> DataFrame:
    """Adds the exponential moving average of the rows that hold a number.

    A row maps the average before it, y, to a * y + b. Maps compose, so a pass joins each
    row's map to the one 1, 2, 4, ... rows before it; it ends when what lies further
    back is weighted by zero in doubles, or is more rows than a partition can hold.
    """
    alpha = 2.0 / (operand["N"] + 1) if "N" in operand else float(operand["alpha"])
    if not 0 < alpha <= 1:
        raise ExpressionError("$expMovingAvg takes a positive N, or an alpha above 0 and at most 1")
    ctx = Ctx(df)
    e = compile_expr(operand["input"], ctx)
    x = e.col.cast("double") if e.kind == "number" else F.lit(None).cast("double")
    df = df.withColumn(to, x)
    has = F.col(to).isNotNull()
    df = df.withColumn("__at", F.row_number().over(Window.partitionBy(part, has).orderBy(*sort_keys(Ctx(df), order))))
    rows = Window.partitionBy(part, has).orderBy("__at")
    df = df.withColumn("__a", F.when(F.col("__at") == 1, 0.0).otherwise(1 - alpha))
    df = df.withColumn("__b", F.when(F.col("__at") == 1, F.col(to)).otherwise(alpha * F.col(to)))
    span = 1
    while span < 2**31 and (1 - alpha) ** span > 0:
        df = df.withColumns({"__p": F.lag("__a", span, 1.0).over(rows), "__q": F.lag("__b", span, 0.0).over(rows)})
        joined = F.when(F.col("__a") == 0, F.col("__b")).otherwise(F.col("__b") + F.col("__a") * F.col("__q"))
        df = df.withColumns({"__a": F.col("__a") * F.col("__p"), "__b": joined})
        span *= 2
    return df.withColumn(to, F.col("__b")).drop("__at", "__a", "__b", "__p", "__q")


def _steps(output: dict[str, Any], ctx: Ctx, order: Order, ordered) -> list[tuple[str, Column]]:
    """For each ``$integral`` with a unit the trapezoid between a row and the one before, so that a frame is a sum.

    For each ``$linearFill`` the row's number and the last value seen with its place, taken from one sort.
    """
    out = []
    for name, node in output.items():
        if order and "$linearFill" in node:
            y, at = _points(node["$linearFill"], ctx, order)
            running = ordered.rowsBetween(Window.unboundedPreceding, 0)
            seen = [F.last(c, ignorenulls=True).over(running).alias(k) for k, c in (("y", y), ("x", at))]
            out.append((name, F.struct(F.row_number().over(ordered).alias("n"), *seen)))
            continue
        operand = node.get("$integral")
        if not order or not isinstance(operand, dict) or operand.get("unit") is None:
            continue
        x = _number(compile_expr(f"${order[0][0]}", ctx)).cast("double") / MILLIS[operand["unit"]]
        y = compile_expr(operand["input"], ctx).col.cast("double")
        out.append((name, (x - F.lag(x).over(ordered)) * (y + F.lag(y).over(ordered)) / 2))
    return out


def _points(operand: Any, ctx: Ctx, order: Order) -> tuple[Column, Column]:
    """The values that ``$linearFill`` draws lines between, and where they are."""
    y = compile_expr(operand, ctx).col
    return y, F.when(y.isNotNull(), _number(compile_expr(f"${order[0][0]}", ctx)).cast("double"))


def _frame(frame: dict | None, ctx: Ctx, order: Order, whole, ordered):
    if not frame or "documents" not in frame and "range" not in frame:
        return whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if "documents" in frame:
        lo, hi = frame["documents"]
        return ordered.rowsBetween(_bound(lo, True), _bound(hi, False))
    lo, hi = frame["range"]
    if len(order) != 1:
        raise ExpressionError("a range window takes one sort key")
    e = compile_expr(f"${order[0][0]}", ctx)
    if order[0][1] < 0:
        raise ExpressionError("a range window takes an ascending sort key")
    scale = 1
    if e.kind == "date":
        if frame.get("unit") not in MILLIS:
            raise ExpressionError("a range window over dates takes a unit of fixed length")
        scale = MILLIS[frame["unit"]]
    return whole.orderBy(_number(e).asc()).rangeBetween(_bound(lo, True, scale), _bound(hi, False, scale))


def _ranking(op: str, operand: Any, ctx: Ctx, order: Order, whole, ordered, frame, step: str | None = None) -> Column:
    if op == "$documentNumber":
        return F.row_number().over(ordered)
    if op == "$rank":
        return F.rank().over(ordered)
    if op == "$denseRank":
        return F.dense_rank().over(ordered)
    if op == "$shift":
        e, by = compile_expr(operand["output"], ctx), int(operand["by"])
        moved = (F.lead(e.col, by) if by >= 0 else F.lag(e.col, -by)).over(ordered)
        if operand.get("default") is None:
            return moved
        there = (F.lead(F.lit(True), by) if by >= 0 else F.lag(F.lit(True), -by)).over(ordered)
        return F.when(there, moved).otherwise(compile_expr(operand["default"], ctx).col)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    if op == "$locf":
        return F.last(compile_expr(operand, ctx).col, ignorenulls=True).over(running)
    if op == "$linearFill":
        y, at = _points(operand, ctx, order)
        x = _number(compile_expr(f"${order[0][0]}", ctx)).cast("double")
        y0, x0 = F.col(step)["y"], F.col(step)["x"]
        # what follows is running in the reversed order: Spark scans a frame that ends unbounded anew for each row
        following = whole.orderBy(F.col(step)["n"].desc()).rowsBetween(Window.unboundedPreceding, 0)
        y1, x1 = (F.last(c, ignorenulls=True).over(following) for c in (y, at))
        return F.when(y.isNotNull(), y.cast("double")).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    w = _frame(frame, ctx, order, whole, ordered)
    if op in ("$covariancePop", "$covarianceSamp"):
        a, b = (compile_expr(x, ctx).col.cast("double") for x in operand)
        return (F.covar_pop if op == "$covariancePop" else F.covar_samp)(a, b).over(w)
    if op == "$expMovingAvg":
        # rows without a number carry the average on
        return F.coalesce(F.col(step), F.last(F.col(step), ignorenulls=True).over(running))
    e = compile_expr(operand["input"], ctx)
    y = e.col.cast("double")
    unit = operand.get("unit")
    if unit is not None:
        x = _number(compile_expr(f"${order[0][0]}", ctx)).cast("double") / MILLIS[unit]
    else:
        x = F.row_number().over(ordered).cast("double")
    if op == "$derivative":
        first, last = F.first(F.struct(x.alias("x"), y.alias("y"))), F.last(F.struct(x.alias("x"), y.alias("y")))
        first, last = (first.over(w), last.over(w)) if unit is not None else (None, None)
        if unit is None:
            n = F.count(F.lit(1)).over(w)
            return F.when(n > 1, (F.last(y).over(w) - F.first(y).over(w)) / (n - 1))
        return F.when(last["x"] != first["x"], (last["y"] - first["y"]) / (last["x"] - first["x"]))
    # trapezoids between neighbours, in the frame's rows in order
    if unit is None:
        total, n = F.sum(y).over(w), F.count(F.lit(1)).over(w)
        return F.when(n > 1, total - (F.first(y).over(w) + F.last(y).over(w)) / 2).otherwise(F.lit(0.0))
    # the frame's first row ends a trapezoid that lies before the frame
    area, n = F.col(step), F.count(F.lit(1)).over(w)
    before = F.first(area).over(w)
    whole_frame = F.count(area).over(w) - before.isNotNull().cast("int") == n - 1
    total = F.coalesce(F.sum(area).over(w), F.lit(0.0)) - F.coalesce(before, F.lit(0.0))
    return F.when(n < 2, F.lit(0.0)).when(whole_frame, total)


def fill(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """``$fill``: a value, the last one seen, or a line between the neighbours."""
    by = spec.get("partitionBy")
    if by is None and spec.get("partitionByFields"):
        by = {f.replace(".", "_"): f"${f}" for f in spec["partitionByFields"]}
    window, plain = {}, {}
    for name, how in spec["output"].items():
        if "method" in how:
            window[name] = {"$locf" if how["method"] == "locf" else "$linearFill": f"${name}"}
        else:
            plain[name] = how["value"]
    if window:
        df = set_window_fields(df, {"partitionBy": by, "sortBy": spec.get("sortBy"), "output": window})
    if plain:
        from .rows import set_fields

        ctx = Ctx(df)
        df = set_fields(df, {k: compile_expr({"$ifNull": [f"${k}", v]}, ctx).col for k, v in plain.items()})
    return df


