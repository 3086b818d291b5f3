"""The functions of one argument, as functions of formulas."""

from __future__ import annotations

from functools import partial

from .nodes import function
from .parse import ALIASES, ARITY

# one name for each function of one argument, and for each of their other names
globals().update({name: partial(function, name) for name in [*(n for n, k in ARITY.items() if k == 1), *(a for a, n in ALIASES.items() if ARITY[n] == 1)]})
