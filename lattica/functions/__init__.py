"""Expression operators, compiled to Spark columns."""
from . import arrays, dates, scalars  # noqa: F401  (they register their operators)
from .core import Ctx, Ex, compile_expr, expression

__all__ = ["Ctx", "Ex", "compile_expr", "expression"]
