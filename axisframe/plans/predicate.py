"""Text predicates over named axes as Spark columns. Parsed, never evaluated as Python."""

from __future__ import annotations

import ast
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE: dict[type, Callable] = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}
_ARITHMETIC: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b,
    ast.Mod: lambda a, b: F.pmod(a, b), ast.Pow: lambda a, b: F.pow(a, b), ast.FloorDiv: lambda a, b: F.floor(a / b),
    ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b, ast.BitXor: lambda a, b: a != b,
}
_CALLS: dict[str, Callable] = {
    "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10,
    "sin": F.sin, "cos": F.cos, "round": F.bround, "lower": F.lower, "upper": F.upper, "length": F.length,
    "startswith": lambda a, b: F.startswith(a, b), "contains": lambda a, b: F.contains(a, b),
}


class Predicate:
    """A parsed predicate: ``column`` and the axes it ``names``."""

    def __init__(self, text: str, columns: dict[str, Column], params: dict[str, Any] | None = None):
        self.text, self.columns, self.params = text, columns, params or {}
        self.names: list[str] = []
        try:
            tree = ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise ValueError(f"not a predicate: {text!r}") from e
        self.column: Column = self._of(tree)
        if not self.names:
            raise ValueError(f"{text!r} names none of the axes {sorted(columns)}")
        #: ``axis == something`` as the whole predicate
        self.equality = isinstance(tree, ast.Compare) and len(tree.ops) == 1 and isinstance(tree.ops[0], ast.Eq) and len(set(self.names)) == 1

    def _of(self, n: ast.AST):
        if isinstance(n, ast.Constant):
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            if n.id in self.columns:
                if n.id not in self.names:
                    self.names.append(n.id)
                return self.columns[n.id]
            if n.id in self.params:
                return self._param(n.id)
            raise ValueError(f"unknown name {n.id!r} in {self.text!r}")
        if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == "kwargs" and isinstance(n.slice, ast.Constant):
            return self._param(n.slice.value)
        if isinstance(n, ast.Compare):
            left, out = n.left, None
            for op, right in zip(n.ops, n.comparators, strict=True):
                if isinstance(op, ast.In | ast.NotIn):
                    test = self._of(left).isin(self._items(right))
                    test = ~test if isinstance(op, ast.NotIn) else test
                elif type(op) in _COMPARE:
                    test = _COMPARE[type(op)](self._of(left), self._of(right))
                else:
                    raise ValueError(f"operator not allowed in {self.text!r}")
                out, left = test if out is None else out & test, right
            return out
        if isinstance(n, ast.BoolOp):
            parts = [self._of(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return out
        if isinstance(n, ast.UnaryOp):
            v = self._of(n.operand)
            if isinstance(n.op, ast.Not | ast.Invert):
                return ~v
            return -v if isinstance(n.op, ast.USub) else v
        if isinstance(n, ast.BinOp) and type(n.op) in _ARITHMETIC:
            return _ARITHMETIC[type(n.op)](self._of(n.left), self._of(n.right))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
            return _CALLS[n.func.id](*(self._of(a) for a in n.args))
        raise ValueError(f"{ast.unparse(n)!r} is not allowed in a predicate")

    def _param(self, name: str):
        if name not in self.params:
            raise ValueError(f"no parameter {name!r} for {self.text!r}")
        return F.lit(self.params[name])

    def _items(self, n: ast.AST) -> list:
        if isinstance(n, ast.List | ast.Tuple | ast.Set):
            return [ast.literal_eval(x) for x in n.elts]
        if isinstance(n, ast.Name) and n.id in self.params:
            return list(self.params[n.id])
        raise ValueError(f"a list is needed after 'in' in {self.text!r}")
