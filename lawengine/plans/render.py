"""Trees to text that parses to the same tree, to LaTeX, and to an outline."""

from __future__ import annotations

from .nodes import Aggregate, Binary, Call, Delay, Expr, Gather, GroupedParameter, Indexed, Lift, Number, Parameter, Reduction, Symbol, Unary

_LEVEL = {"+": 10, "-": 10, "*": 20, "/": 20, "**": 40}


def _number(v: float, number_format: str | None) -> str:
    return format(v, number_format) if number_format else repr(v)


def render(e: Expr, *, latex: bool = False, number_format: str | None = None) -> str:
    return (to_latex if latex else to_text)(e, number_format)


def to_text(e: Expr, number_format: str | None = None) -> str:
    return _text(e, 0, number_format)


def _wrap(text: str, level: int, least: int) -> str:
    return f"({text})" if level < least else text


def _text(e: Expr, least: int, f: str | None) -> str:
    """least: the level that the place asks for without parentheses."""
    own = lambda x: _text(x, 0, f)
    if isinstance(e, Number):
        text = _number(e.value, f)
        return _wrap(text, 30 if text.startswith("-") else 100, least)
    if isinstance(e, Symbol):
        return e.name
    if isinstance(e, Parameter):
        return f"param({e.name!r})" if e.value is None else f"param({e.name!r}, value={e.value!r})"
    if isinstance(e, GroupedParameter):
        more = "".join(f", {k}={v!r}" for k, v in (("value", e.value), ("default", e.default)) if v is not None)
        return f"grouped_param({own(e.by)}, name={e.name!r}{more})"
    if isinstance(e, Unary):
        return _wrap("-" + _text(e.operand, 30, f), 30, least)
    if isinstance(e, Binary):
        level = _LEVEL[e.op]
        left, right = (level + 1, 30) if e.op == "**" else (level, level + 1)
        return _wrap(f"{_text(e.left, left, f)} {e.op} {_text(e.right, right, f)}", level, least)
    if isinstance(e, Call):
        return f"{e.name}({', '.join(map(own, e.args))})"
    if isinstance(e, Delay):
        return f"delay({own(e.operand)}, {own(e.lag)})"
    if isinstance(e, Indexed):
        return f"{_text(e.base, 90, f)}[{', '.join(e.indices)}]"
    if isinstance(e, Reduction):
        return f"sum[{', '.join(e.indices)}]({', '.join(own(x) for x in (e.relation, e.body) if x is not None)})"
    if isinstance(e, Gather):
        return f"gather({own(e.relation)}, {own(e.body)})"
    if isinstance(e, Aggregate):
        return f"aggr({own(e.relation)}, {own(e.body)})"
    if isinstance(e, Lift):
        return f"{'targ' if e.role == 'target' else 'sour'}({own(e.operand)})"
    raise TypeError(type(e).__name__)


def to_latex(e: Expr, f: str | None = None) -> str:
    return _latex(e, 0, f)


def _latex(e: Expr, least: int, f: str | None) -> str:
    own = lambda x: _latex(x, 0, f)
    wrap = lambda text, level: rf"\left({text}\right)" if level < least else text
    if isinstance(e, Unary):
        return wrap("-" + _latex(e.operand, 30, f), 30)
    if isinstance(e, Binary):
        if e.op == "/":
            return rf"\frac{{{own(e.left)}}}{{{own(e.right)}}}"
        if e.op == "**":
            return wrap(f"{_latex(e.left, 41, f)}^{{{own(e.right)}}}", 40)
        level = _LEVEL[e.op]
        return wrap(f"{_latex(e.left, level, f)} {r'\cdot' if e.op == '*' else e.op} {_latex(e.right, level + 1, f)}", level)
    if isinstance(e, Call):
        if e.name == "sqrt":
            return rf"\sqrt{{{own(e.args[0])}}}"
        if e.name == "abs":
            return rf"\left|{own(e.args[0])}\right|"
        return rf"\operatorname{{{e.name}}}\left({', '.join(map(own, e.args))}\right)"
    if isinstance(e, Indexed):
        return f"{_latex(e.base, 90, f)}_{{{','.join(e.indices)}}}"
    if isinstance(e, Reduction):
        weight = "" if e.relation is None else _latex(e.relation, 20, f) + r" \cdot "
        return wrap(rf"\sum_{{{','.join(e.indices)}}} {weight}{_latex(e.body, 20, f)}", 15)
    if isinstance(e, (Parameter, GroupedParameter)):
        return rf"\theta_{{{e.name}}}"
    return _text(e, least, f)


def to_tree(e: Expr, depth: int = 0) -> str:
    told = {Number: lambda: repr(e.value), Symbol: lambda: e.name, Parameter: lambda: e.name, GroupedParameter: lambda: e.name, Binary: lambda: e.op, Call: lambda: e.name, Indexed: lambda: ", ".join(e.indices), Reduction: lambda: ", ".join(e.indices), Lift: lambda: e.role}
    label = type(e).__name__ + (f" {told[type(e)]()}" if type(e) in told else "")
    return "\n".join(["  " * depth + label, *(to_tree(x, depth + 1) for x in e.operands)])
