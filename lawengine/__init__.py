"""A PySpark-native engine for discovering and checking mathematical laws.

The names of the formula language are exported here; each is imported when it is first asked for, so that Python workers
load no more than they need.
"""

from importlib import import_module

_WHERE = {
    "plans.nodes": "Aggregate Binary Call Delay Expr Gather GroupedParameter Indexed Lift Number Parameter Reduction Symbol Unary Variable aggr delay function gather grouped_param param reduction sour targ",
    "plans.lower": "bind_parameters count_parameters desugar fold_constants parameter_values unbound_parameters",
    "plans.unary": "abs acos arccos arcsin arctan asin atan cos cosh cot csc exp inv lg ln log log10 log2 sec sech sigmoid sign sin sinh sqrt tan tanh",
    "plans.indexed": "Graph evaluate",
    "plans.parse": "parse",
    "plans.render": "render",
    "operators.nonlinear": "FitResult fit",
}
_OTHER = {"Expression": "Expr", "Function": "Call"}
_HOME = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted([*_HOME, *_OTHER])  # noqa: PLE0605


def __getattr__(name: str):
    own = _OTHER.get(name, name)
    if own not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME[own]}", __name__), own)


def __dir__():
    return __all__
