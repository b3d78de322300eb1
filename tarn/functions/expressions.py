"""Contract expressions: one Python expression of ``x`` compiled to a Column.

A whitelist over the syntax tree; whatever is not on it is refused. Failing
conversions give null (which counts as an error of the value), as do operations
on null.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import regex
from tarn.functions import text as X


class Refused(ValueError):
    """An expression outside the vocabulary."""


class _V:
    """A column and the kind of its values (str, int, float, bool, date, list or none); a constant keeps its value."""

    def __init__(self, col: Column, kind: str, value: object = None, constant: bool = False):
        self.col, self.kind, self.value, self.constant = col, kind, value, constant


def _lit(value: object) -> _V:
    return _V(F.lit(value), "none" if value is None else type(value).__name__, value, True)


def _const(v: _V, kind: type) -> object:
    if v.constant and isinstance(v.value, kind):
        return v.value
    raise Refused("a constant is needed")


def _number(v: _V) -> Column:
    if v.kind == "bool":
        return v.col.cast("int")
    if v.kind not in ("int", "float"):
        raise Refused(f"{v.kind} as a number")
    return v.col


def _truth(v: _V) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind == "none":
        return F.lit(False)
    return v.col != "" if v.kind == "str" else F.size(v.col) > 0 if v.kind == "list" else v.col != 0 if v.kind in ("int", "float") else v.col.isNotNull()


def float_text(x: Column) -> Column:
    """A double as Python writes it: plain from 1e-4 up to 1e16, with all its digits, else with an exponent."""
    a, java = F.abs(x), x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,22)").cast("string"), "0+$", ""), r"\.$", ".0")
    digits, power = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", ""), F.substring_index(java, "E", -1)
    two = F.lpad(F.regexp_replace(power, "^-", ""), F.greatest(F.lit(2), F.length(F.regexp_replace(power, "^-", ""))), F.lit("0"))
    small = F.concat(digits, F.when(F.startswith(power, F.lit("-")), "e-").otherwise("e+"), two)
    special = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(special, F.when((a >= 1e-3) & (a < 1e7) | (a == 0), java).when((a >= 1e-4) & (a < 1e16), plain).otherwise(small))


# Strptime directives and Spark's patterns.
DATE_PARTS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%I": "hh", "%p": "a"}


def _date_pattern(fmt: str) -> str:
    out = re.sub("%.", lambda m: DATE_PARTS.get(m[0], ""), fmt)
    if any(d not in DATE_PARTS for d in re.findall("%.", fmt)):
        raise Refused("date directive")
    return re.sub(r"(?<![A-Za-z])T(?![A-Za-z])", "'T'", out)


def compile_expression(source: str, x: Column) -> Column:
    """The Column of an expression over the string column x."""
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise Refused(str(e)) from e
    return _Compiler(x).visit(tree).col


class _Compiler(ast.NodeVisitor):
    def __init__(self, x: Column):
        self.x = x

    def generic_visit(self, node: ast.AST) -> _V:
        raise Refused(type(node).__name__)

    def visit_Name(self, node: ast.Name) -> _V:
        if node.id != "x":
            raise Refused(node.id)
        return _V(self.x, "str")

    def visit_Constant(self, node: ast.Constant) -> _V:
        if node.value is not None and not isinstance(node.value, (str, int, float, bool)):
            raise Refused("constant")
        return _lit(node.value)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> _V:
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return _V(~_truth(v), "bool")
        if isinstance(node.op, ast.USub):
            return _lit(-v.value) if v.constant and v.kind in ("int", "float") else _V(F.try_subtract(F.lit(0 if v.kind != "float" else 0.0), _number(v)), "float" if v.kind == "float" else "int")
        raise Refused("operator")

    def visit_BinOp(self, node: ast.BinOp) -> _V:
        a, b = self.visit(node.left), self.visit(node.right)
        if a.kind == b.kind == "str" and isinstance(node.op, ast.Add):
            return _V(F.concat(a.col, b.col), "str")
        if {a.kind, b.kind} == {"str", "int"} and isinstance(node.op, ast.Mult):
            t, n = (a, b) if a.kind == "str" else (b, a)
            return _V(F.repeat(t.col, n.col.cast("int")), "str")
        kind = "float" if "float" in (a.kind, b.kind) else "int"
        x, y = _number(a), _number(b)
        if kind == "float":
            x, y = x.cast("double"), y.cast("double")
        if isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)):
            f = F.try_add if isinstance(node.op, ast.Add) else F.try_subtract if isinstance(node.op, ast.Sub) else F.try_multiply
            return _V(f(x.cast("long"), y.cast("long")) if kind == "int" else f(x, y), kind)
        if isinstance(node.op, ast.Div):
            return _V(F.try_divide(x.cast("double"), y.cast("double")), "float")
        if isinstance(node.op, ast.FloorDiv):
            if kind == "float":
                return _V(F.floor(F.try_divide(x, y)).cast("double"), kind)
            r = F.try_mod(x, y)
            r = F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)
            return _V(F.try_divide(F.try_subtract(x, r).cast("decimal(20,0)"), y.cast("decimal(20,0)")).try_cast("long"), kind)
        if isinstance(node.op, ast.Mod):
            r = F.try_mod(x, y)
            return _V(F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r), kind)  # the divisor's sign
        if isinstance(node.op, ast.Pow):
            p = F.pow(x.cast("double"), y.cast("double"))
            if kind == "int" and b.constant and b.value >= 0:
                return _V(p.try_cast("long"), "int")
            return _V(p, "float")
        raise Refused("operator")

    def visit_BoolOp(self, node: ast.BoolOp) -> _V:
        """The first operand that decides, as in Python; operands of different kinds are refused."""
        parts = [self.visit(v) for v in node.values]
        kinds = {p.kind for p in parts} - {"none"}
        if len(kinds) > 1:
            raise Refused("operands of different kinds")
        out = parts[-1].col
        for p in reversed(parts[:-1]):
            t = _truth(p)
            out = F.when(t, p.col).when(~t, out) if isinstance(node.op, ast.Or) else F.when(t, out).when(~t, p.col)
        return _V(out, kinds.pop() if kinds else "none")

    def visit_Compare(self, node: ast.Compare) -> _V:
        out, left = None, self.visit(node.left)
        for op, node_right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)) and isinstance(node_right, (ast.List, ast.Tuple)):
                values = [self.visit(e) for e in node_right.elts]
                part = F.lit(False)
                for v in values:
                    part = part | self._equal(left, v)
                right = left
            elif isinstance(op, (ast.In, ast.NotIn)):
                right = self.visit(node_right)
                if right.kind == "list":
                    part = F.array_contains(right.col, left.col)
                elif left.kind == right.kind == "str":
                    part = F.contains(right.col, left.col)
                else:
                    raise Refused("in")
            elif isinstance(op, (ast.Is, ast.IsNot)):
                right = self.visit(node_right)
                if right.kind != "none":
                    raise Refused("is")
                part = F.lit(left.kind == "none")
            else:
                right = self.visit(node_right)
                part = self._ordered(op, left, right)
            part = ~part if isinstance(op, (ast.NotIn, ast.IsNot, ast.NotEq)) else part
            out, left = part if out is None else out & part, right
        return _V(out, "bool")

    def _equal(self, a: _V, b: _V) -> Column:
        numbers = {"int", "float", "bool"}
        if a.kind in numbers and b.kind in numbers:
            return _number(a) == _number(b)
        return a.col == b.col if a.kind == b.kind else F.when(a.col.isNotNull() | b.col.isNotNull(), F.lit(False))

    def _ordered(self, op: ast.cmpop, a: _V, b: _V) -> Column:
        if isinstance(op, (ast.Eq, ast.NotEq)):
            return self._equal(a, b)
        x, y = (a.col, b.col) if a.kind == b.kind and a.kind in ("str", "date") else (_number(a), _number(b))
        if isinstance(op, (ast.Lt, ast.LtE)):
            return x < y if isinstance(op, ast.Lt) else x <= y
        if isinstance(op, (ast.Gt, ast.GtE)):
            return x > y if isinstance(op, ast.Gt) else x >= y
        raise Refused("comparison")

    def visit_IfExp(self, node: ast.IfExp) -> _V:
        t, a, b = self.visit(node.test), self.visit(node.body), self.visit(node.orelse)
        kinds = {a.kind, b.kind} - {"none"}
        if len(kinds) > 1 and kinds != {"int", "float"}:
            raise Refused("branches of different kinds")
        truth = _truth(t)
        return _V(F.when(truth, a.col).when(~truth, b.col), "float" if "float" in kinds else kinds.pop() if kinds else "none")

    def visit_Subscript(self, node: ast.Subscript) -> _V:
        v, s = self.visit(node.value), node.slice
        if v.kind not in ("str", "list"):
            raise Refused("subscript")
        n = F.length(v.col) if v.kind == "str" else F.size(v.col)
        if isinstance(s, ast.Slice):
            if s.step is not None:
                raise Refused("step")
            place = lambda e, default: default if e is None else F.lit(k) if (k := _const(self.visit(e), int)) >= 0 else F.greatest(n + k, F.lit(0))
            begin, end = place(s.lower, F.lit(0)), place(s.upper, n)
            size = F.greatest(F.least(end, n) - begin, F.lit(0))
            return _V(F.substr(v.col, begin + 1, size) if v.kind == "str" else F.slice(v.col, begin + 1, size), v.kind)
        i = _const(self.visit(s), int)
        at = F.lit(i) if i >= 0 else n + i
        if v.kind == "list":
            return _V(F.when(at >= 0, F.get(v.col, at)), "str")
        return _V(F.when((at >= 0) & (at < n), F.substr(v.col, at + 1, F.lit(1))), "str")

    def visit_Call(self, node: ast.Call) -> _V:
        if node.keywords:
            raise Refused("keyword arguments")
        f = node.func
        if isinstance(f, ast.Name) and f.id == "isinstance":
            return self._isinstance(node.args)
        if isinstance(f, ast.Name):
            return self._function(f.id, [self.visit(a) for a in node.args])
        if isinstance(f, ast.Attribute):
            if isinstance(f.value, ast.Name) and f.value.id in ("re", "datetime"):
                return self._module(f.value.id, f.attr, [self.visit(a) for a in node.args])
            if f.attr == "group" and isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Attribute):
                return self._group(f.value, node.args)
            return self._method(self.visit(f.value), f.attr, [self.visit(a) for a in node.args])
        raise Refused("call")

    def _isinstance(self, args: list[ast.expr]) -> _V:
        if len(args) != 2:
            raise Refused("isinstance")
        named = args[1].elts if isinstance(args[1], ast.Tuple) else [args[1]]
        if not all(isinstance(t, ast.Name) and t.id in ("str", "int", "float", "bool", "list") for t in named):
            raise Refused("type")
        v = self.visit(args[0])
        kinds = {t.id for t in named} | ({"bool"} if any(t.id == "int" for t in named) else set())
        return _V(F.when(v.col.isNotNull(), F.lit(v.kind in kinds)), "bool")

    def _group(self, call: ast.Call, group: list[ast.expr]) -> _V:
        """re.match(...).group(i) and re.search(...).group(i); no match is an error."""
        name, args = call.func.attr, [self.visit(a) for a in call.args]
        if not isinstance(call.func.value, ast.Name) or call.func.value.id != "re" or name not in ("match", "search") or len(args) != 2:
            raise Refused("group")
        i = _const(self.visit(group[0]), int) if group else 0
        pattern = self._pattern(_const(args[0], str))
        if i > re.compile(_const(args[0], str)).groups:
            raise Refused("no such group")
        pattern = f"^(?:{pattern})" if name == "match" else pattern
        return _V(F.when(args[1].col.rlike(pattern), F.regexp_extract(args[1].col, pattern, i)), "str")

    def _pattern(self, pattern: str) -> str:
        if not regex.valid(pattern):
            raise Refused("pattern")
        return regex.translated(pattern)

    def _function(self, name: str, args: list[_V]) -> _V:
        if not args:
            raise Refused(name)
        v = args[0]
        if name == "int" and len(args) == 1:
            if v.kind == "str":
                t = F.replace(X.strip(v.col), F.lit("_"), F.lit(""))
                return _V(F.when(X.strip(v.col).rlike(r"^[+-]?\d+(_\d+)*$"), t.try_cast("long")), "int")
            if v.kind == "float":  # towards zero; none of what has no integer
                return _V(v.col.try_cast("long"), "int")
            return _V(_number(v).cast("long"), "int")
        if name == "float" and len(args) == 1:
            if v.kind == "str":
                t = X.strip(v.col)
                d = r"\d+(?:_\d+)*"
                return _V(F.when(t.rlike(rf"^(?i)[+-]?((?:{d}\.?(?:{d})?|\.{d})(?:e[+-]?{d})?|inf|infinity|nan)$"), F.replace(t, F.lit("_"), F.lit("")).try_cast("double")), "float")
            return _V(_number(v).cast("double"), "float")
        if name == "str" and len(args) == 1:
            if v.kind == "float":
                return _V(float_text(v.col), "str")
            if v.kind == "bool":
                return _V(F.initcap(v.col.cast("string")), "str")
            if v.kind in ("str", "int"):
                return _V(v.col.cast("string"), "str")
        if name == "len" and len(args) == 1 and v.kind in ("str", "list"):
            return _V(F.length(v.col) if v.kind == "str" else F.size(v.col), "int")
        if name == "abs" and len(args) == 1:
            return _V(F.abs(_number(v)), v.kind)
        if name == "round" and len(args) <= 2:
            if len(args) == 1:
                return _V(F.rint(_number(v).cast("double")).try_cast("long"), "int")
            return _V(F.bround(_number(v), _const(args[1], int)), v.kind)
        if name in ("min", "max") and len(args) > 1 and len({a.kind for a in args}) == 1:
            out, known = v.col, v.col.isNotNull()
            for a in args[1:]:  # the first one stays unless a later one is beyond it, so also beside one that isn't a number
                beyond = a.col < out if name == "min" else a.col > out
                beyond = beyond & ~F.isnan(out) & ~F.isnan(a.col) if v.kind == "float" else beyond
                out, known = F.when(beyond, a.col).otherwise(out), known & a.col.isNotNull()
            return _V(F.when(known, out), v.kind)
        if name == "bool" and len(args) == 1:
            return _V(_truth(v), "bool")
        raise Refused(name)

    def _module(self, module: str, name: str, args: list[_V]) -> _V:
        if module == "re" and name == "sub" and len(args) == 3:
            new = _const(args[1], str).replace("$", r"\$")
            return _V(F.regexp_replace(args[2].col, F.lit(self._pattern(_const(args[0], str))), F.lit(re.sub(r"\\(?:g<)?(\d)>?", r"$\1", new))), "str")
        if module == "datetime" and name == "strptime" and len(args) == 2:
            return _V(F.try_to_timestamp(args[0].col, F.lit(_date_pattern(_const(args[1], str)))), "date")
        if module == "datetime" and name == "fromisoformat" and len(args) == 1:
            return _V(F.when(args[0].col.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?$"), F.try_to_timestamp(F.regexp_replace(args[0].col, r"([T ]\d{2})$", "$1:00"))), "date")
        raise Refused(f"{module}.{name}")

    def _method(self, v: _V, name: str, args: list[_V]) -> _V:
        if v.kind == "list" or v.kind != "str":
            raise Refused(name)
        t, c = v.col, [a.value for a in args if a.constant and a.kind == "str"]
        simple = {"lower": lambda: (F.lower(t), "str"), "upper": lambda: (F.upper(t), "str"), "isdigit": lambda: (t.rlike(r"^\d+$"), "bool"), "title": lambda: (_title(t), "str"), "capitalize": lambda: (F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2)))), "str")}
        if name in simple and not args:
            return _V(*simple[name]())
        if name in ("strip", "lstrip", "rstrip") and len(args) == len(c) <= 1:
            chars = f"[{re.escape(c[0])}]" if c and c[0] else r"[\s\p{Z}]"
            if c and not c[0]:
                return v
            t = F.regexp_replace(t, f"^{chars}+", "") if name != "rstrip" else t
            return _V(F.regexp_replace(t, rf"{chars}+\z", "") if name != "lstrip" else t, "str")
        if name == "replace" and len(c) == len(args) == 2:
            if not c[0]:
                raise Refused("empty text")
            return _V(F.replace(t, F.lit(c[0]), F.lit(c[1])), "str")
        if name == "split" and len(c) == len(args) == 1 and c[0]:
            return _V(F.split(t, rf"\Q{c[0]}\E"), "list")
        if name == "split" and not args:
            return _V(F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w != ""), "list")
        if name in ("startswith", "endswith") and len(c) == len(args) == 1:
            return _V((F.startswith if name == "startswith" else F.endswith)(t, F.lit(c[0])), "bool")
        if name == "zfill" and len(args) == 1:
            n = _const(args[0], int)
            sign = F.regexp_extract(t, "^([+-]?)", 1)
            rest = F.substr(t, F.length(sign) + 1)
            return _V(F.when(F.length(t) >= n, t).otherwise(F.concat(sign, F.repeat(F.lit("0"), F.greatest(F.lit(n) - F.length(t), F.lit(0))), rest)), "str")
        raise Refused(name)


def _title(t: Column) -> Column:
    """Each run of letters with its first one upper and the others lower."""
    parts = F.regexp_extract_all(t, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


# Expression and pattern by the target of a contract where no other is known.
FALLBACKS = {
    "int": ("int(x)", "^-?[0-9]+$"),
    "float": ("float(x)", "^-?[0-9]+\\.?[0-9]*$"),
    "str": ("x", "^.+$"),
    "datetime": ("x", "^\\d{4}-\\d{2}-\\d{2}$"),
}
