"""Linear fits: the triangular factor of the columns comes from one pass (`functions.triangular`), and small algebra on it from the driver."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations, combinations_with_replacement, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.chance import chance
from ..functions.triangular import factor, merged
from .profile import _column


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, as a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + t * d) or tiny), (1 + t / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def t_tails(t: float, dof: float) -> float:
    """Probability that Student's t is further from zero than t."""
    return math.nan if math.isnan(t) else _beta(dof / (dof + t * t), dof / 2, 0.5) if math.isfinite(t) else 0.0


def t_quantile(p: float, dof: float) -> float:
    """Student's t, by halving on its distribution function."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        if 1 - 0.5 * t_tails(mid, dof) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


# polynomials


def allowed_pairs(features: list[str], *, interactions: bool = True, only: list[tuple[str, str]] | None = None, never: list[tuple[str, str]] | None = None) -> set[tuple[str, str]]:
    """Pairs of features that may stand in one term, as sorted pairs: all of them, or those of `only`, less those of `never`."""
    if not interactions:
        return set()
    pairs = {tuple(sorted(p)) for p in combinations(features, 2)}
    if only is not None:
        pairs &= {tuple(sorted(p)) for p in only}
    return pairs - {tuple(sorted(p)) for p in never or ()}


def monomials(features: list[str], degree: int, *, interactions: bool = True, only: list[tuple[str, str]] | None = None, never: list[tuple[str, str]] | None = None) -> list[tuple[int, ...]]:
    """Powers in order of total degree, then of the powers themselves; the constant is left out."""
    pairs = allowed_pairs(features, interactions=interactions, only=only, never=never)
    out = set()
    for d in range(1, degree + 1):
        for pick in combinations_with_replacement(range(len(features)), d):
            if all(tuple(sorted((features[i], features[j]))) in pairs for i, j in combinations(sorted(set(pick)), 2)):
                out.add(tuple(pick.count(i) for i in range(len(features))))
    return sorted(out, key=lambda p: (sum(p), p))


def monomial(features: list[Column], powers: tuple[int, ...]) -> Column:
    out = None
    for x, p in zip(features, powers, strict=True):
        for _ in range(p):
            out = x if out is None else out * x
    return out


def _name(features: list[str], powers: tuple[int, ...]) -> str:
    return "*".join(f if p == 1 else f"{f}**{p}" for f, p in zip(features, powers, strict=True) if p) or "1"


def polynomial_fit(df: DataFrame, features: list[str], target: str, *, degree: int = 2, interactions: bool = True, only: list[tuple[str, str]] | None = None, never: list[tuple[str, str]] | None = None, intercept: bool = True, prune: bool = True) -> dict:
    """Least squares on monomials, with standard errors, t and p values of the full fit, and what was pruned.

    Terms are pruned together, round by round: those whose contribution (coefficient times monomial) is negligible both in
    root mean square (1e-6 of the target's) and at most (1e-5 of it), as long as the refitted error grows by no more
    than 1e-6 of the target's root mean square. The last term is never pruned.
    """
    cols = [_column(f) for f in features]
    terms = monomials(features, degree, interactions=interactions, only=only, never=never)
    named = {_name(features, p): monomial(cols, p) for p in terms}
    target_column = _column(target)
    g = factor(df, named | {"_target": target_column})
    names = [*named]
    largest = df.select(*[c.alias(f"_x{i}") for i, c in enumerate([*named.values(), target_column])])
    ok = ieee.finite(F.col("_x0"))
    for i in range(1, len(names) + 1):
        ok = ok & ieee.finite(F.col(f"_x{i}"))
    top = largest.filter(ok).agg(*[F.max(F.abs(f"_x{i}")).alias(f"m{i}") for i in range(len(names))]).first()
    sizes = [g.rms(i) for i in range(len(names) + 1)]
    use, size = list(range(len(names))), max(sizes[-1], 2.220446049250313e-16)
    c, left = g.solve(use, intercept=intercept)
    p = len(use) + intercept
    dof = g.n - p
    inverse, mean = g.inverse(use, intercept), g.mean
    spread = left / dof if dof > 0 else math.nan
    errors = {names[i]: math.sqrt(max(spread * inverse[k, k], 0.0)) if dof > 0 else math.nan for k, i in enumerate(use)}
    if intercept:
        errors["1"] = math.sqrt(max(spread * (1 / g.n + mean[use] @ inverse @ mean[use]), 0.0)) if dof > 0 else math.nan
    full = {names[i]: float(v) for i, v in zip(use, c, strict=False)} | ({"1": float(c[-1])} if intercept else {})
    t = {n: v / errors[n] if errors[n] else math.copysign(math.inf, v) if v else math.nan for n, v in full.items()}
    removed: list[dict] = []
    constant = intercept
    while prune:
        share = {i: (abs(v) * sizes[i], abs(v) * top[f"m{i}"]) for i, v in zip(use, c, strict=False)}
        gone = [i for i, (r, most) in share.items() if r <= 1e-6 * size and most <= 1e-5 * size]
        drop = constant and abs(c[-1]) <= 1e-6 * size
        if len(gone) == len(use) and (drop or not constant):  # one has to stay
            keep = max([*share, *[None] * drop], key=lambda i: abs(c[-1]) if i is None else share[i][0])
            gone, drop = [i for i in gone if i != keep], drop and keep is not None
        if not gone and not drop:
            break
        fewer = [i for i in use if i not in gone]
        c2, left2 = g.solve(fewer, intercept=constant and not drop)
        if math.sqrt(left2 / g.n) > math.sqrt(left / g.n) + 1e-6 * size:
            break
        removed += [{"term": names[i], "coefficient": float(v), "rms": share[i][0], "largest": share[i][1]} for i, v in zip(use, c, strict=False) if i in gone]
        if drop:
            removed.append({"term": "1", "coefficient": float(c[-1]), "rms": abs(float(c[-1])), "largest": abs(float(c[-1]))})
        use, c, left, constant = fewer, c2, left2, constant and not drop
    found = {names[i]: float(v) for i, v in zip(use, c, strict=False)}
    text = " + ".join([*([repr(float(c[-1]))] if constant else []), *(f"{v!r} * {n}" for n, v in found.items())]) or "0.0"
    return {
        "coefficients": found | ({"1": float(c[-1])} if constant else {}), "std_errors": errors, "t": t, "p": {n: t_tails(v, max(dof, 1)) for n, v in t.items()},
        "rmse": math.sqrt(left / g.n), "rank": g.rank, "deficient": g.rank < len(names), "n": g.n, "removed": removed, "formula": text,
    }


# power laws


def snap(v: float, *, largest: int = 6, tolerance: float = 1e-2) -> Fraction | None:
    f = Fraction(v).limit_denominator(largest)
    return f if abs(float(f) - v) <= tolerance else None


def power_law_fit(df: DataFrame, features: list[str], target: str, *, key: str | None = None, folds: int = 10, confidence: float = 0.95) -> dict:
    """y = c * prod x^a by least squares on logarithms, if all values are positive and finite; intervals by leaving
    out each fold of key in turn (pseudo-values)."""
    from .profile import positive_domain

    bad = [r.asDict() for r in positive_domain(df, {n: n for n in [*features, target]}).filter("not_positive + not_finite > 0").collect()]
    if bad:
        return {"status": "domain_inapplicable", "violations": bad}
    logs = {n: F.log(_column(n)) for n in [*features, target]}
    if key is None:
        total, parts = factor(df, logs), {}
    else:
        parts = factor(df, logs, by=F.pmod(F.col(key), F.lit(folds)))
        total = merged(list(parts.values()))
    c, left = total.solve()
    out = {"status": "ok", "scale": math.exp(c[-1]), "exponents": dict(zip(features, map(float, c[:-1]), strict=True)), "rmse_log": math.sqrt(left / total.n), "n": total.n}
    out["snapped"] = {f: str(s) for f, v in out["exponents"].items() if (s := snap(v)) is not None}
    if len(parts) > 2:
        k = len(parts)
        pseudo = np.array([k * c - (k - 1) * merged([p for other, p in parts.items() if other != fold]).solve()[0] for fold in parts])
        half = t_quantile(0.5 + confidence / 2, k - 1) * pseudo.std(0, ddof=1) / math.sqrt(k)
        out["intervals"] = {f: (float(m - h), float(m + h)) for f, m, h in zip(features, pseudo.mean(0), half, strict=False)}
    return out


# rational functions


def rational_fit(df: DataFrame, x: str, y: str, *, degrees: int = 2, key: str | None = None, penalty: float = 1e-3, held: float = 0.2) -> dict:
    """P(x) / Q(x) with Q(0) = 1, linearised, over a grid of degrees; chosen by the error on held-out rows, plus a
    penalty for each term. Alternatives within 5 % are kept; a denominator that changes sign or vanishes is told."""
    a, t = _column(x), _column(y)
    rows = df.select(a.alias("x"), t.alias("y"), (chance(F.col(key) if key else F.concat_ws(",", a, t)) < held).alias("held"))
    train = rows.filter(~F.col("held"))
    cols = {f"x{k}": F.pow("x", F.lit(float(k))) for k in range(1, degrees + 1)} | {f"yx{k}": -F.col("y") * F.pow("x", F.lit(float(k))) for k in range(1, degrees + 1)} | {"_y": F.col("y")}
    g = factor(train, cols)
    tried = []
    for p, q in product(range(degrees + 1), range(degrees + 1)):
        c, _ = g.solve([*range(p), *range(degrees, degrees + q)])
        tried.append({"p": [float(c[-1]), *map(float, c[:p])], "q": [1.0, *map(float, c[p:-1])]})

    def poly(c: list[float]) -> Column:
        out = F.lit(float(c[-1]))
        for v in reversed(c[:-1]):
            out = out * F.col("x") + v
        return out

    scores = []
    for i, m in enumerate(tried):  # all candidates in one pass
        d = poly(m["q"])
        safe = F.abs(d) > 1e-12
        e = F.col("y") - poly(m["p"]) / F.when(safe, d)
        scores += [F.sqrt(F.avg(F.when(F.col("held"), e * e))).alias(f"e{i}"), F.sqrt(F.avg(e * e)).alias(f"a{i}"), F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.count_if(~safe).alias(f"bad{i}")]
    r = rows.agg(F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("size"), *scores).first()
    for i, m in enumerate(tried):
        m |= {"held_rmse": r[f"e{i}"], "rmse": r[f"a{i}"], "terms": len(m["p"]) + len(m["q"]) - 1, "pole": bool(r[f"bad{i}"]) or r[f"lo{i}"] * r[f"hi{i}"] <= 0}
        m["score"] = (m["held_rmse"] if m["held_rmse"] is not None else math.inf) / (r["size"] or 1.0) + penalty * m["terms"]
    tried.sort(key=lambda m: (m["score"], m["terms"]))
    best = tried[0]
    near = [m for m in tried if m["held_rmse"] is not None and m["held_rmse"] - best["held_rmse"] <= 0.05 * r["size"] and not any(o["held_rmse"] <= m["held_rmse"] and o["terms"] < m["terms"] for o in tried if o["held_rmse"] is not None)]
    return best | {"alternatives": near}


# sparse and harmonic regression


def stlsq(df: DataFrame, library: dict[str, Column], target: str, *, threshold: float = 0.1, alpha: float = 0.05, rounds: int = 20) -> dict[str, float]:
    """Sequentially thresholded ridge regression on a library of columns: one pass, all rounds on the driver."""
    g = factor(df, library | {"_target": _column(target)})
    use = list(range(len(library)))
    c = np.zeros(1)
    for _ in range(rounds):
        c, _ = g.solve(use, ridge=alpha)
        kept = [i for i, v in zip(use, c, strict=False) if abs(v) >= threshold]
        if kept == use:
            break
        use = kept
    c, _ = g.solve(use)
    tidy = lambda v: float(round(v)) if abs(v) < 1000 and abs(v - round(v)) <= 0.005 else float(v)
    out = {g.names[i]: tidy(v) for i, v in zip(use, c, strict=False)}
    if abs(c[-1]) >= threshold:
        out["1"] = tidy(c[-1])
    return out


def polynomial_library(features: list[str], degree: int = 2, *, frequencies: int = 0) -> dict[str, Column]:
    cols = [_column(f) for f in features]
    out = {_name(features, p): monomial(cols, p) for p in monomials(features, degree)}
    for k in range(1, frequencies + 1):
        for f, c in zip(features, cols, strict=True):
            out |= {f"sin({k} * {f})": F.sin(c * float(k)), f"cos({k} * {f})": F.cos(c * float(k))}
    return out


def harmonic_fit(df: DataFrame, x: str, t: str, y: str, *, degree: int = 1, intercept: bool = True, frequencies: list[float] | None = None, cycles: float = 20.0, grid: int = 320, best: int = 8, refine: int = 12) -> dict:
    """y = a + sum of b_k x^k + c x sin(w t), k up to degree; omega, a, powers (the b_k; b is the first), c and rmse.

    The frequencies of a grid (a quarter of a cycle over the range of t up to `cycles` of them, if none are given) are tried in one
    pass or a few; then the `best` of those that beat their neighbours are refined together, each in a bracket of nine
    points that is a quarter as wide every time; after two times the best one alone.
    """
    a, s, v = _column(x), _column(t), _column(y)
    rows = df.select(a.alias("x"), s.alias("s"), v.alias("y")).filter(ieee.finite(F.col("x")) & ieee.finite(F.col("s")) & ieee.finite(F.col("y")))
    scale = rows.agg(F.max(F.abs("x")).alias("x"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n")).first()
    if not scale["n"] or scale["n"] < degree + 4 or scale["lo"] == scale["hi"]:
        raise ValueError("too few rows, or a constant phase")
    if frequencies is None:
        span = scale["hi"] - scale["lo"]
        frequencies = np.linspace(math.pi / (2 * span), 2 * math.pi * max(cycles, 0.5) / span, grid).tolist()
    size = scale["x"] or 1.0
    z = F.col("x") / size
    base = ([F.lit(1.0)] if intercept else []) + [F.pow(z, F.lit(float(k))) for k in range(1, degree + 1)]
    plain = [(f"p{i}_{j}", F.sum(base[i] * base[j])) for i in range(len(base)) for j in range(i, len(base))] + [(f"q{i}", F.sum(b * F.col("y"))) for i, b in enumerate(base)]
    fixed = rows.agg(F.sum(F.col("y") * F.col("y")).alias("yy"), *[c.alias(k) for k, c in plain]).first()
    seen: dict[float, dict] = {}

    def tried(at: list[float], chunk: int = 40) -> None:
        for lo in range(0, len(at), chunk):
            sums = []
            for i, w in enumerate(at[lo : lo + chunk]):
                h = z * F.sin(F.col("s") * float(w))
                sums += [F.sum(h * h).alias(f"h{i}"), F.sum(h * F.col("y")).alias(f"y{i}"), *[F.sum(h * b).alias(f"b{i}_{k}") for k, b in enumerate(base)]]
            r = rows.agg(*sums).first()
            for i, w in enumerate(at[lo : lo + chunk]):
                n = len(base)
                m, q = np.zeros((n + 1, n + 1)), np.array([*[fixed[f"q{k}"] for k in range(n)], r[f"y{i}"]])
                for j in range(n):
                    m[j, n] = m[n, j] = r[f"b{i}_{j}"]
                    for k in range(j, n):
                        m[j, k] = m[k, j] = fixed[f"p{j}_{k}"]
                m[n, n] = r[f"h{i}"]
                d = np.sqrt(np.maximum(np.diag(m), 1e-300))
                c = np.linalg.lstsq(m / np.outer(d, d), q / d, rcond=1e-13)[0] / d
                seen[w] = {"left": max(float(fixed["yy"] - 2 * c @ q + c @ m @ c), 0.0), "c": c}

    tried(frequencies)
    left = [seen[w]["left"] for w in frequencies]
    low = [i for i in range(len(frequencies)) if left[i] <= min(left[max(i - 1, 0)], left[min(i + 1, len(left) - 1)])]
    centres = [frequencies[i] for i in sorted(low, key=lambda i: left[i])[:best]]
    step = (frequencies[1] - frequencies[0]) if len(frequencies) > 1 else 0.0
    for k in range(refine if step else 0):
        centres = centres if k < 2 else [min(centres, key=lambda w: seen[w]["left"])]  # by then the brackets are narrow enough to tell
        at = [[w + step * i / 4 for i in range(-4, 5)] for w in centres]
        tried([w for own in at for w in own if w not in seen])
        centres = [min(own, key=lambda w: seen[w]["left"]) for own in at]
        step /= 4
    omega = min(seen, key=lambda w: seen[w]["left"])
    c = seen[omega]["c"]
    powers = [float(v) / size**k for k, v in enumerate(c[int(intercept) : -1], 1)]
    return {"omega": float(omega), "a": float(c[0]) if intercept else 0.0, "b": powers[0], "powers": powers, "c": float(c[-1]) / size, "left": seen[omega]["left"], "rmse": math.sqrt(seen[omega]["left"] / scale["n"])}
