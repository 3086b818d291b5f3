"""Registered queries over the test tables, each beside the SQL that states the same result where SQL can.

Doubles are rounded to nine significant digits on both sides: sums of doubles depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ieee, metrics, ranges
from ..functions.deploy import importable
from ..operators import delay as delays
from ..operators import constants, fits, noise, nonlinear, profile, rollout, split, text
from ..streaming import events, ring
from .indexed import Graph
from .nodes import Binary, Expr, Number, Symbol, Unary
from .parse import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keeps decimal halves, which the two sides round differently, off the boundary.
NUDGE = 1.0000000000001


def sig(c: Column) -> Column:
    """Nine significant digits; what is not finite becomes null."""
    return F.when(ieee.finite(c), F.format_string("%.8e", F.when(ieee.finite(c), c).otherwise(F.lit(0.0)) * NUDGE).cast("double"))


def S(x: str) -> str:
    return f"CASE WHEN isfinite(CAST(({x}) AS DOUBLE)) THEN CAST(printf('%.8e', CAST(({x}) AS DOUBLE) * CAST('1.0000000000001' AS DOUBLE)) AS DOUBLE) END"


#: Six digits, for results that steps approach.
_S6 = "CAST(printf('%.5e', {0}) AS DOUBLE)"


def told(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded, all else as it is."""
    return df.select(*[sig(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _one(spark: SparkSession, row: dict) -> DataFrame:
    """A row of driver-side results."""
    return told(spark.createDataFrame([tuple(float(v) if isinstance(v, float) else v for v in row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items())))


def least_squares_sql(terms: dict[str, str], y: str, source: str, *, digits: int = 5) -> str:
    """(term, coefficient, std_error) of y on the terms and a constant, by Gram-Schmidt: each column less its slopes on those before it."""
    n = len(terms)
    steps = [f"g0 AS MATERIALIZED (SELECT CAST({y} AS DOUBLE) AS y, {', '.join(f'CAST({e} AS DOUBLE) AS c{k}' for k, e in enumerate(terms.values()))} FROM {source})"]
    for k in range(n):
        slopes = "".join(f" - (SELECT covar_pop(c{k}, r{j}) / var_pop(r{j}) FROM g{k}) * r{j}" for j in range(k))
        steps.append(f"g{k + 1} AS MATERIALIZED (SELECT *, c{k} - (SELECT avg(c{k}) FROM g{k}){slopes} AS r{k} FROM g{k})")
    last = f"g{n}"
    one = ["count(*) AS n", "avg(y) AS my", *[f"avg(c{k}) AS m{k}" for k in range(n)], *[f"covar_pop(y, r{k}) / var_pop(r{k}) AS b{k}" for k in range(n)], *[f"covar_pop(c{m}, r{k}) / var_pop(r{k}) AS a{k}_{m}" for k in range(n) for m in range(k + 1, n)]]
    one += [f"var_pop(r{k}) AS v{k}" for k in range(n)]
    steps.append(f"h AS MATERIALIZED (SELECT {', '.join(one)} FROM {last})")
    before = "h"
    for k in range(n - 1, -1, -1):  # coefficients from the last one back, and the inverse of the triangle of slopes
        beta = f"b{k}" + "".join(f" - a{k}_{m} * e{m}" for m in range(k + 1, n))
        steps.append(f"i{k} AS MATERIALIZED (SELECT *, {beta} AS e{k} FROM {before})")
        before = f"i{k}"
    steps.append(f"o AS MATERIALIZED (SELECT *, my{''.join(f' - e{k} * m{k}' for k in range(n))} AS e FROM {before})")
    steps.append(f"q AS MATERIALIZED (SELECT sum((y - o.e{''.join(f' - o.e{k} * c{k}' for k in range(n))}) ** 2) / max(o.n - {n + 1}) AS s2 FROM {last}, o)")
    inverse: dict[tuple[int, int], str] = {}
    for m in range(n):
        inverse[m, m] = "1.0"
        for k in range(m - 1, -1, -1):
            inverse[k, m] = "(0.0" + "".join(f" - a{k}_{j} * {inverse[j, m]}" for j in range(k + 1, m + 1)) + ")"
    error = lambda k: "sqrt(s2 * (" + " + ".join(f"{inverse[k, m]} ** 2 / (n * v{m})" for m in range(k, n)) + "))"
    lever = " + ".join(f"({' + '.join(f'm{k} * {inverse[k, m]}' for k in range(m + 1))}) ** 2 / (n * v{m})" for m in range(n))
    told_ = lambda x: f"CAST(printf('%.{digits}e', CAST({x} AS DOUBLE)) AS DOUBLE)"
    rows = [f"SELECT '{t}' AS term, {told_(f'e{k}')} AS coefficient, {told_(error(k))} AS std_error FROM o, q" for k, t in enumerate(terms)]
    rows.append(f"SELECT '1' AS term, {told_('e')} AS coefficient, {told_(f'sqrt(s2 * (1.0 / n + {lever}))')} AS std_error FROM o, q")
    return "WITH " + ",\n".join(steps) + "\n" + " UNION ALL ".join(rows)


def rounded(v: float, digits: int = 5) -> float:
    return float(f"{v:.{digits}e}")


def to_sql(e: Expr) -> str:
    """A formula of plain arithmetic and of functions that DuckDB has; null where a logarithm or a root has no value."""
    if isinstance(e, Number):
        return repr(float(e.value))
    if isinstance(e, Symbol):
        return e.name
    if isinstance(e, Unary):
        return f"(-{to_sql(e.operand)})"
    if isinstance(e, Binary):
        return f"({to_sql(e.left)} {e.op} {to_sql(e.right)})"
    x = to_sql(e.args[0])
    return {"log": f"(CASE WHEN {x} > 0 THEN ln({x}) END)", "sqrt": f"(CASE WHEN {x} >= 0 THEN sqrt({x}) END)", "inv": f"(1.0 / {x})"}[e.name]


#: The chance of a key, as split.random has it.
CHANCE = "(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) / 4294967296.0)"


PRED = "l_quantity * p_retailprice"
JOINED = "(SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p, l_orderkey, l_linenumber, l_quantity, l_shipdate, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its part: the small side is left to Spark's own size check."""
    parts = read(spark, d, "part").select("p_partkey", "p_retailprice")
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return df.withColumns({"y": F.col("l_extendedprice"), "p": parse(PRED).to_column()})


# formulas and metrics


@query(f"""SELECT count(*) AS n, {S("avg((y-p)*(y-p))")} AS mse, {S("sqrt(avg((y-p)*(y-p)))")} AS rmse, {S("avg(abs(y-p))")} AS mae,
{S("avg(CASE WHEN y<>0 THEN abs((y-p)/y) END)")} AS mape, {S("1 - sum((y-p)*(y-p))/(var_pop(y)*count(y))")} AS r2,
{S("count(y)*ln(sum((y-p)*(y-p))/count(y)) + 4")} AS aic, {S("count(y)*ln(sum((y-p)*(y-p))/count(y)) + 2*ln(count(y))")} AS bic, {S("corr(y,p)")} AS pearson FROM {JOINED}""")
def formula_metrics(spark, d):
    return told(lines(spark, d).agg(*metrics.bundle(F.col("y"), F.col("p"), 2)))


@query(f"""SELECT {S("1 - sum((y-p)*(y-p))/(var_pop(y)*count(y))")} AS r2, {S("sqrt(avg((y-p)*(y-p)))")} AS rmse, {S("avg(2*abs(y-p)/(abs(y)+abs(p)+1e-6))")} AS smape,
{S("avg(abs(y-p)/(abs(y)+1e-6))")} AS mape, {S("avg(abs(y-p))")} AS mae FROM {JOINED}""")
def alternative_metrics(spark, d):
    return told(lines(spark, d).agg(*metrics.alternative(F.col("y"), F.col("p"))))


@query(f"""SELECT {S("avg((y-p)*(y-p))")} AS mse, {S("avg((y-p)*(y-p))/var_pop(y)")} AS nmse, {S("1 - sum((y-p)*(y-p))/(var_pop(y)*count(y))")} AS r2,
{S("avg(abs(y-p)/greatest(abs(y),2.220446049250313e-16))")} AS mape, {S("avg(CASE WHEN abs(y-p)<=0.1*abs(y) THEN 1.0 ELSE 0.0 END)")} AS acc_01, count(y) AS n FROM {JOINED}""")
def bench_metrics(spark, d):
    return told(lines(spark, d).agg(*metrics.benchmark(F.col("y"), F.col("p"))))


def _functions(names: list[str], x: str) -> Callable:
    def run(spark, d):
        df = read(spark, d, "customer")
        out = []
        for n in names:
            c = parse(f"{n}({x})").to_column()
            out += [sig(c).alias(f"f_{n}"), F.when(F.isnan(c), "nan").when(c == ieee.INF, "inf").when(c == -ieee.INF, "-inf").otherwise("number").alias(f"k_{n}")]
        return df.select("c_custkey", *out)

    return run


def _functions_sql(forms: dict[str, str]) -> str:
    cols = ", ".join(f"{S(f)} AS f_{n}, CASE WHEN isnan({f}) THEN 'nan' WHEN {f} = 'inf'::DOUBLE THEN 'inf' WHEN {f} = '-inf'::DOUBLE THEN '-inf' ELSE 'number' END AS k_{n}" for n, f in forms.items())
    return f"SELECT c_custkey, {cols} FROM (SELECT c_custkey, c_acctbal, c_acctbal / 1000 AS x, c_acctbal / 12000 AS u FROM customer)"


_TRIG = {"sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "arctan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)", "sec": "1/cos(x)", "csc": "1/sin(x)", "cot": "1/tan(x)", "sech": "1/cosh(x)", "exp": "exp(x)"}
_LOG = {"log": "CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "log10": "CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "log2": "CASE WHEN x > 0 THEN log2(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END", "sqrt": "CASE WHEN x >= 0 THEN sqrt(greatest(x, 0)) ELSE 'nan'::DOUBLE END", "inv": "1/x"}
_MISC = {"abs": "abs(x)", "sign": "CAST(sign(x) AS DOUBLE)", "pow2": "x*x", "pow3": "x*x*x", "sigmoid": "1/(1+exp(-x))"}
QUERIES["scalar_fns_trig"] = _functions(list(_TRIG), "c_acctbal / 1000")
ORACLES["scalar_fns_trig"] = _functions_sql(_TRIG)
QUERIES["scalar_fns_log"] = _functions(list(_LOG), "c_acctbal / 1000")
ORACLES["scalar_fns_log"] = _functions_sql(_LOG)
QUERIES["scalar_fns_misc"] = _functions(list(_MISC), "c_acctbal / 1000")
ORACLES["scalar_fns_misc"] = _functions_sql(_MISC)
QUERIES["scalar_fns_arc"] = _functions(["arcsin", "arccos"], "c_acctbal / 12000")
ORACLES["scalar_fns_arc"] = _functions_sql({"arcsin": "asin(u)", "arccos": "acos(u)"})


def six(c: Column) -> Column:
    """Six decimals, by arithmetic alone: for functions of many rows whose last bit differs from one library to the next."""
    return F.floor(c * 1e6 + 0.5).cast("double") / 1e6


#: Sums, products, quotients and choices of doubles are the same to the last bit on both sides, and are not rounded.
@query("""SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 500) AS hi, least(l_quantity, l_tax * 500) AS lo, CASE WHEN l_discount <> l_tax THEN l_quantity / (l_discount - l_tax) END AS ratio,
CASE WHEN l_discount = l_tax THEN 'inf' ELSE 'number' END AS kind, floor(power(l_quantity, l_discount) * 1e6 + 0.5) / 1e6 AS pw, -l_tax + 2 * l_quantity AS lin FROM lineitem""")
def scalar_arithmetic(spark, d):
    ratio = parse("l_quantity / (l_discount - l_tax)").to_column()
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", parse("max(l_quantity, l_tax * 500)").to_column().alias("hi"), parse("min(l_quantity, l_tax * 500)").to_column().alias("lo"), F.when(ieee.finite(ratio), ratio).alias("ratio"),
        F.when(F.abs(ratio) == ieee.INF, "inf").otherwise("number").alias("kind"), six(parse("l_quantity ** l_discount").to_column()).alias("pw"), parse("-l_tax + 2 * l_quantity").to_column().alias("lin"),
    )


@query(f"""SELECT c_mktsegment, count(*) AS n, {S("sum((CASE c_mktsegment WHEN 'BUILDING' THEN 2.0 WHEN 'MACHINERY' THEN 3.0 ELSE 0.5 END) * c_acctbal)")} AS total FROM customer GROUP BY 1""")
def grouped_param_eval(spark, d):
    f = parse("grouped_param(c_mktsegment, name='slope', value={'BUILDING': 2.0, 'MACHINERY': 3.0}, default=0.5) * c_acctbal")
    return told(f.evaluate(read(spark, d, "customer")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


# profiles

_PROFILED = {"quantity": "l_quantity", "price": "l_extendedprice", "margin": parse("l_extendedprice * (1 - l_discount) - 30000")}
_PROFILED_SQL = "(SELECT unnest(['quantity','price','margin']) AS variable, unnest([l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) - 30000]) AS v FROM lineitem)"


@query(f"""SELECT variable, count(*) AS n, count(*) FILTER (isfinite(v)) AS finite, count(*) FILTER (v = 'inf'::DOUBLE) AS pos_inf, count(*) FILTER (v = '-inf'::DOUBLE) AS neg_inf, count(*) FILTER (isnan(v)) AS nan,
{S("min(v)")} AS min, {S("max(v)")} AS max, {S("avg(v)")} AS mean, {S("var_pop(v)")} AS variance, {S("stddev_pop(v)")} AS std, {S("quantile_cont(v,0.25)")} AS q1, {S("quantile_cont(v,0.5)")} AS median, {S("quantile_cont(v,0.75)")} AS q3,
count(*) FILTER (v>0) AS positive, count(*) FILTER (v<0) AS negative, count(*) FILTER (v=0) AS zero, {S("count(*) FILTER (v>0) / count(v)::DOUBLE")} AS positive_ratio, {S("count(*) FILTER (v<0) / count(v)::DOUBLE")} AS negative_ratio,
count(*) FILTER (abs(v)<=1) AS near_zero_0, count(*) FILTER (abs(v)<=1e-6) AS near_zero_1, count(*) FILTER (abs(v)<=1e-4) AS near_zero_2 FROM {_PROFILED_SQL} GROUP BY 1""")
def profile_stats(spark, d):
    return told(profile.summary(read(spark, d, "lineitem"), _PROFILED, near_zero=(1.0,)))


@query(f"""WITH x AS {_PROFILED_SQL}, s AS (SELECT variable, min(v) AS lo, max(v) AS hi, (max(v)-min(v))/12 AS w FROM x GROUP BY 1),
c AS (SELECT variable, CAST(least(floor((v-lo)/w), 11) AS INTEGER) AS bin, lo, hi, w, count(*) AS n FROM x JOIN s USING (variable) GROUP BY ALL)
SELECT variable, bin, {S("lo + bin*w")} AS low, {S("CASE WHEN bin=11 THEN hi ELSE lo + (bin+1)*w END")} AS high, n FROM c""")
def profile_hist(spark, d):
    return told(profile.histogram(read(spark, d, "lineitem"), _PROFILED, bins=12))


@query(f"""WITH r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2.0 AS ry FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem))
SELECT {S("corr(rx,ry)")} AS spearman, {S("corr(x,y)")} AS pearson, count(*) AS n FROM r""")
def spearman_pearson(spark, d):
    return told(metrics.spearman(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


_BINS = "WITH p AS (SELECT l_extendedprice AS x, l_discount * l_quantity AS y FROM lineitem), q AS ({edges}), b AS (SELECT x, y, CAST(len(list_filter(e, lambda z: z <= x)) AS INTEGER) AS bin FROM p, q) SELECT bin, count(*) AS n, " + f"{S('avg(y)')} AS y_mean, {S('stddev_pop(y)')} AS y_std, {S('min(y)')} AS y_min, {S('max(y)')} AS y_max, {S('min(x)')} AS x_min, {S('max(x)')} AS x_max FROM b GROUP BY 1"


@query(_BINS.replace("{edges}", "SELECT list_sort(list_distinct(quantile_cont(x, [0.125,0.25,0.375,0.5,0.625,0.75,0.875]))) AS e FROM p"))
def conditional_bins(spark, d):
    return told(profile.conditional(read(spark, d, "lineitem"), "l_extendedprice", parse("l_discount * l_quantity"), bins=8))


@query(_BINS.replace("{edges}", "SELECT [min(x) + (max(x)-min(x))*i/8 FOR i IN [1,2,3,4,5,6,7]] AS e FROM p"))
def equal_width_bins(spark, d):
    return told(profile.conditional(read(spark, d, "lineitem"), "l_extendedprice", parse("l_discount * l_quantity"), bins=8, method="width"))


@query(f"""WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey % 5 AS fold FROM lineitem), q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS e FROM p),
b AS (SELECT x, y, fold, len(list_filter(e, lambda z: z <= x)) AS bin FROM p, q), g AS (SELECT bin, fold, count(*) AS n, sum(y) AS s FROM b GROUP BY 1,2),
m AS (SELECT g.bin, g.fold, (t.s - g.s)/(t.n - g.n) AS guess FROM g JOIN (SELECT bin, sum(n) AS n, sum(s) AS s FROM g GROUP BY 1) t USING (bin))
SELECT CAST(count(*) AS BIGINT) AS n, {S("1 - sum((y-guess)*(y-guess))/(var_pop(y)*count(*))")} AS cv_r2 FROM b JOIN m USING (bin, fold)""")
def cv_collapse_bins(spark, d):
    return told(profile.collapse(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_orderkey"))


_PAIRS = "(SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey % 5 AS fold, l_discount AS o1, l_tax AS o2 FROM lineitem)"
_CROSS = f"""p AS {_PAIRS}, q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS e FROM p),
b AS (SELECT p.*, len(list_filter(e, lambda z: z <= x)) AS bin FROM p, q), g AS (SELECT bin, fold, count(*) AS n, sum(y) AS s FROM b GROUP BY 1,2),
m AS (SELECT g.bin, g.fold, (t.s - g.s)/(t.n - g.n) AS guess FROM g JOIN (SELECT bin, sum(n) AS n, sum(s) AS s FROM g GROUP BY 1) t USING (bin))"""


@query(f"""WITH {_CROSS}, f AS (SELECT fold, count(*) AS n, sum(y) AS s FROM p GROUP BY 1), o AS (SELECT fold, (SELECT sum(s) FROM f) - s AS s, (SELECT sum(n) FROM f) - n AS n FROM f),
r AS (SELECT fold, 1 - sum((y - guess) ** 2) / sum((y - o.s / o.n) ** 2) AS r2 FROM b JOIN m USING (bin, fold) JOIN o USING (fold) GROUP BY 1)
SELECT {S('avg(r2)')} AS mean_r2, {S('stddev_pop(r2)')} AS std_r2, count(*) AS folds FROM r""")
def cv_collapse_folds(spark, d):
    return told(profile.collapse_by_fold(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_orderkey"))


@query()
def cv_collapse_spline(spark, d):
    return told(profile.collapse_by_fold(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_orderkey", model="spline"))


@query(f"""WITH r AS (SELECT l_quantity AS x, l_extendedprice + 2000 * l_quantity AS y, l_orderkey % 5 AS fold FROM lineitem),
c AS MATERIALIZED (SELECT x, f.fold, count(*) FILTER (r.fold <> f.fold) AS w, sum(y) FILTER (r.fold <> f.fold) AS s FROM r, (SELECT unnest(range(5)) AS fold) f GROUP BY 1, 2),
p AS MATERIALIZED (SELECT fold, x, w, s, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM c WINDOW o AS (PARTITION BY fold ORDER BY x)),
m AS MATERIALIZED (SELECT a.fold, a.x AS a, b.x AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean FROM p a JOIN p b ON a.fold = b.fold AND a.x <= b.x),
g AS MATERIALIZED (SELECT fold, x, max(low) AS guess FROM (SELECT p.fold, p.x, m.a, min(mean) AS low FROM p JOIN m ON m.fold = p.fold AND m.a <= p.x AND m.b >= p.x GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT fold, sum(s) / sum(w) AS mean FROM c GROUP BY 1), e AS (SELECT fold, 1 - sum((y - guess) ** 2) / sum((y - mean) ** 2) AS r2 FROM r JOIN g USING (fold, x) JOIN t USING (fold) GROUP BY 1)
SELECT {S("avg(r2)")} AS mean_r2, {_S6.format("stddev_pop(r2)")} AS std_r2, count(r2) AS folds FROM e""")
def cv_collapse_isotonic(spark, d):
    """A target that rises with the feature in every fold; SQL has the greatest of the least means of intervals."""
    got = profile.collapse_by_fold(read(spark, d, "lineitem"), "l_quantity", parse("l_extendedprice + 2000 * l_quantity"), "l_orderkey", model="isotonic")
    return told(got.withColumn("std_r2", F.format_string("%.5e", "std_r2").cast("double")), "std_r2")


@query(f"""WITH {_CROSS}, l AS (SELECT o1, o2, y - guess AS left_ FROM b JOIN m USING (bin, fold)),
k AS (SELECT o1, o2, left_, rank() OVER (ORDER BY o1) + (count(*) OVER (PARTITION BY o1) - 1)/2.0 AS r1, rank() OVER (ORDER BY o2) + (count(*) OVER (PARTITION BY o2) - 1)/2.0 AS r2, rank() OVER (ORDER BY left_) + (count(*) OVER (PARTITION BY left_) - 1)/2.0 AS rl FROM l),
c AS (SELECT 'l_discount' AS variable, corr(o1, left_) AS pearson, corr(r1, rl) AS spearman FROM k UNION ALL SELECT 'l_tax', corr(o2, left_), corr(r2, rl) FROM k)
SELECT variable, CAST(printf('%.4e', pearson) AS DOUBLE) AS pearson FROM c ORDER BY greatest(abs(pearson), abs(spearman)) DESC LIMIT 1""")
def residual_association(spark, d):
    r = profile.residual_association(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", {"l_discount": "l_discount", "l_tax": "l_tax"}, "l_orderkey")
    return r.select("variable", F.format_string("%.4e", "pearson").cast("double").alias("pearson"))


@query(f"""WITH r AS (SELECT *, p-y AS r FROM {JOINED}), c AS (SELECT 'quantity' AS variable, count(*) AS n, corr(l_quantity, r) AS c FROM r UNION ALL SELECT 'discount', count(*), corr(l_discount, r) FROM r) SELECT variable, n, {S("c")} AS pearson FROM c ORDER BY abs(c) DESC LIMIT 1""")
def residual_top(spark, d):
    return told(profile.correlations(lines(spark, d), F.col("p") - F.col("y"), {"quantity": "l_quantity", "discount": "l_discount"}, top=1))


@query(f"""SELECT l_orderkey, l_linenumber, {S("y")} AS y, {S("p")} AS prediction, {S("p-y")} AS residual FROM {JOINED} ORDER BY abs(p-y) DESC, l_orderkey, l_linenumber LIMIT 10""")
def residual_worst10(spark, d):
    return told(profile.worst(lines(spark, d), "y", "p", "l_orderkey", "l_linenumber", k=10))


@query(f"""SELECT count(*) AS n, {S("avg(p-y)")} AS bias, {S("stddev_pop(p-y)")} AS std, {S("quantile_cont(abs(p-y),0.5)")} AS abs_p50, {S("quantile_cont(abs(p-y),0.9)")} AS abs_p90, {S("quantile_cont(abs(p-y),0.99)")} AS abs_p99, {S("max(abs(p-y))")} AS abs_max, {S("avg(abs(p-y)/abs(y))")} AS relative_mean FROM {JOINED}""")
def residual_profile(spark, d):
    return told(profile.residuals(lines(spark, d), "y", "p"))


@query(f"""WITH r AS (SELECT *, p-y AS r FROM {JOINED}) SELECT 'quantity' AS variable, count(*) AS n, {S("corr(l_quantity, r)")} AS pearson FROM r UNION ALL SELECT 'discount', count(*), {S("corr(l_discount, r)")} FROM r""")
def residual_correlations(spark, d):
    return told(profile.correlations(lines(spark, d), F.col("p") - F.col("y"), {"quantity": "l_quantity", "discount": "l_discount"}))


@query(f"""SELECT 'l_discount' AS a, 'l_extendedprice' AS b, {S("corr(l_discount,l_extendedprice)")} AS pearson FROM lineitem UNION ALL SELECT 'l_discount','l_quantity',{S("corr(l_discount,l_quantity)")} FROM lineitem UNION ALL SELECT 'l_extendedprice','l_quantity',{S("corr(l_extendedprice,l_quantity)")} FROM lineitem""")
def pairwise_correlations(spark, d):
    return told(profile.pairwise(read(spark, d, "lineitem"), {n: n for n in ("l_quantity", "l_extendedprice", "l_discount")}))


@query("""SELECT 'c_acctbal' AS variable, count(*) FILTER (c_acctbal <= 0) AS not_positive, CAST(0 AS BIGINT) AS not_finite FROM customer UNION ALL SELECT 'c_custkey', count(*) FILTER (c_custkey <= 0), 0 FROM customer""")
def positive_domain(spark, d):
    return profile.positive_domain(read(spark, d, "customer"), {"c_acctbal": "c_acctbal", "c_custkey": "c_custkey"})


@query(f"""WITH c AS (SELECT l_quantity AS x, l_tax AS y, count(*) AS n FROM lineitem GROUP BY 1,2), s AS (SELECT sum(sign((a.x-b.x)*(a.y-b.y))*a.n*b.n) AS s FROM c a JOIN c b ON a.x < b.x), t AS (SELECT sum(n) AS n FROM c),
tx AS (SELECT sum(m*(m-1)/2.0) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY x)), ty AS (SELECT sum(m*(m-1)/2.0) AS t FROM (SELECT sum(n) AS m FROM c GROUP BY y))
SELECT {S("s.s / sqrt((t.n*(t.n-1)/2.0 - tx.t)*(t.n*(t.n-1)/2.0 - ty.t))")} AS kendall_tau FROM s, t, tx, ty""")
def kendall_tau(spark, d):
    return told(metrics.kendall(read(spark, d, "lineitem"), "l_quantity", "l_tax"))


@query(f"""WITH c AS (SELECT o_totalprice AS x, c_acctbal AS y FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT sum(sign((a.x-b.x)*(a.y-b.y))) AS s FROM c a JOIN c b ON a.x < b.x), t AS (SELECT count(*) AS n FROM c),
tx AS (SELECT sum(m*(m-1)/2.0) AS t FROM (SELECT count(*) AS m FROM c GROUP BY x)), ty AS (SELECT sum(m*(m-1)/2.0) AS t FROM (SELECT count(*) AS m FROM c GROUP BY y))
SELECT {S("s.s / sqrt((t.n*(t.n-1)/2.0 - tx.t)*(t.n*(t.n-1)/2.0 - ty.t))")} AS kendall_tau FROM s, t, tx, ty""")
def kendall_continuous(spark, d):
    df = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return told(metrics.kendall(df, "o_totalprice", "c_acctbal"))


@query(f"""SELECT "true", predicted, n, total, {S("n/total")} AS rate FROM (SELECT quality AS "true", toxic AS predicted, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY quality) AS BIGINT) AS total FROM labels GROUP BY 1,2) WHERE "true" <> predicted ORDER BY n/total DESC, 1, 2 LIMIT 10""")
def confusion_top(spark, d):
    return told(metrics.confusion(read(spark, d, "labels"), "quality", "toxic"))


_HITS = "(SELECT c_mktsegment AS segment, n_name, corr(c_acctbal, c_custkey) * corr(c_acctbal, c_custkey) + 0.45 AS r2 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(*) > 4)"


@query("SELECT o_orderpriority AS label, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1")
def first_seen_labels(spark, d):
    return metrics.first_seen(read(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query(f"""SELECT segment, count(*) AS n, {S("avg(CASE WHEN r2>=0.5 THEN 1.0 ELSE 0.0 END)")} AS hit_0_5, {S("avg(CASE WHEN r2>=0.9 THEN 1.0 ELSE 0.0 END)")} AS hit_0_9, {S("avg(CASE WHEN r2>=0.99 THEN 1.0 ELSE 0.0 END)")} AS hit_0_99, {S("avg(CASE WHEN r2>=0.999 THEN 1.0 ELSE 0.0 END)")} AS hit_0_999, {S("avg(r2)")} AS mean_r2 FROM {_HITS} GROUP BY ROLLUP(segment)""")
def hit_rates(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = c.groupBy(F.col("c_mktsegment").alias("segment"), "n_name").agg(F.count("*").alias("m"), metrics.pearson(F.col("c_acctbal"), F.col("c_custkey").cast("double")).alias("r"))
    return told(metrics.hit_rates(own.filter("m > 4").withColumn("r2", F.col("r") * F.col("r") + 0.45), "segment"))


@query("SELECT bool_and(abs(p-t) <= 1e-8 + 1e-6*abs(p)) AS same, bool_and(abs(q-t) <= 1e-8 + 1e-6*abs(q)) AS other FROM (SELECT l_extendedprice*(1-l_discount) AS t, l_extendedprice - l_extendedprice*l_discount AS p, l_extendedprice*(1-l_tax) AS q FROM lineitem)")
def symbolic_accuracy(spark, d):
    t = parse("l_extendedprice * (1 - l_discount)").to_column()
    same, other = parse("l_extendedprice - l_extendedprice * l_discount").to_column(), parse("l_extendedprice * (1 - l_tax)").to_column()
    return read(spark, d, "lineitem").agg(metrics.close(same, t).alias("same"), metrics.close(other, t).alias("other"))


# splits and candidates

_SPLIT_SQL = f"""SELECT split, count(*) AS n, {S("avg((y-p)*(y-p))")} AS mse, {S("min(v)")} AS low, {S("max(v)")} AS high FROM (SELECT o_totalprice AS y, o_totalprice * 0.9 AS p, VAR AS v, CASE WHEN row_number() OVER (ORDER BY VAR, o_orderkey) > (SELECT count(*) - CAST(round_even(count(*)*0.2, 0) AS BIGINT) FROM orders) THEN 'validation' ELSE 'train' END AS split FROM orders) GROUP BY 1"""


def _split(spark, d, variable, method):
    df = read(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp").cast("double"))
    y, p = F.col("o_totalprice"), parse("o_totalprice * 0.9").to_column()
    return told(method(df, variable, key="o_orderkey").groupBy("split").agg(F.count("*").alias("n"), metrics.mse(y, p).alias("mse"), F.min(variable).alias("low"), F.max(variable).alias("high")))


@query(_SPLIT_SQL.replace("VAR", "o_totalprice"))
def ood_split_metrics(spark, d):
    return _split(spark, d, "o_totalprice", split.out_of_domain)


@query(_SPLIT_SQL.replace("VAR", "epoch(o_orderdate)"))
def chrono_split(spark, d):
    return _split(spark, d, "at", split.chronological)


@query(f"SELECT CASE WHEN {CHANCE.format(key='o_orderkey', seed=0)} < 0.2 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def random_split(spark, d):
    return split.random(read(spark, d, "orders"), "o_orderkey").groupBy("split").agg(F.count("*").alias("n"))


_CANDIDATES = ["l_extendedprice", "l_quantity * 1000", "l_quantity * 1000 + l_tax", "l_extendedprice * (1 - l_discount)", "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "l_extendedprice - l_discount"]
_CANDIDATES_SQL = "WITH c AS (" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS candidate_id, CAST({len(parse(f))} AS BIGINT) AS complexity, {S(f'avg((l_extendedprice*(1-l_discount)*1.04 - ({f}))*(l_extendedprice*(1-l_discount)*1.04 - ({f})))')} AS metric FROM lineitem" for i, f in enumerate(_CANDIDATES)) + ")"


def candidate_table(spark, d) -> DataFrame:
    """All formulas scored in one pass."""
    y = parse("l_extendedprice * (1 - l_discount) * 1.04").to_column()
    cells = [F.struct(F.lit(i).cast("long").alias("candidate_id"), F.lit(f).alias("formula"), F.lit(len(parse(f))).cast("long").alias("complexity"), sig(metrics.mse(y, parse(f).to_column())).alias("metric")) for i, f in enumerate(_CANDIDATES)]
    return read(spark, d, "lineitem").agg(F.array(*cells).alias("all")).select(F.inline("all"))


def _network_sql(value: str, bits: str, seed: int) -> str:
    """The permutation of split.shuffled, one step."""
    half = f"((1 << {bits}) - 1)"
    left, right = f"(({value}) >> {bits})", f"(({value}) & {half})"
    for k in range(split.ROUNDS):
        of = f"(CAST('0x' || substr(md5(CAST({right} AS VARCHAR) || ':{seed}:{k}'), 1, 8) AS BIGINT) & {half})"
        left, right = right, f"xor({left}, {of})"
    return f"(({left}) << {bits} | {right})"


@query(f"""WITH RECURSIVE s AS (SELECT count(*) AS n, CAST(ceil(ceil(log2(count(*))) / 2) AS BIGINT) AS bits FROM part),
w AS (SELECT p_partkey, p_partkey - (SELECT min(p_partkey) FROM part) AS place, true AS start FROM part UNION ALL SELECT p_partkey, {_network_sql("place", "bits", 3)}, false FROM w, s WHERE start OR place >= n),
e AS (SELECT p_partkey, place FROM w, s WHERE NOT start AND place < n)
SELECT p_partkey, CAST(CASE WHEN place < (n % 5) * (n // 5 + 1) THEN place // (n // 5 + 1) ELSE n % 5 + (place - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM e, s""")
def exact_folds(spark, d):
    part = read(spark, d, "part").select("p_partkey")
    first = part.agg(F.min("p_partkey")).first()[0]
    return split.exact_folds(part.withColumn("row", F.col("p_partkey") - F.lit(first)), "row", 5, seed=3).select("p_partkey", "fold")


@query("SELECT count(*) FILTER (step <= 0) AS violations FROM (SELECT epoch(o_orderdate) - lag(epoch(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders)")
def increasing_times(spark, d):
    df = read(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp").cast("double"))
    return split.strictly_increasing(df, "at", "o_custkey", order="o_orderkey")


@query(_CANDIDATES_SQL + " SELECT candidate_id, complexity, metric, row_number() OVER (ORDER BY metric, complexity, candidate_id) AS rank FROM c")
def candidate_rank(spark, d):
    return split.ranked(candidate_table(spark, d)).select("candidate_id", "complexity", "metric", F.col("rank").cast("long").alias("rank"))


@query(_CANDIDATES_SQL + ", r AS (SELECT *, row_number() OVER (ORDER BY metric, complexity, candidate_id) AS rank FROM c) SELECT candidate_id, complexity, metric FROM (SELECT *, min(complexity) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r) WHERE b IS NULL OR complexity < b")
def candidate_pareto(spark, d):
    return split.pareto(candidate_table(spark, d)).select("candidate_id", "complexity", "metric")


@query(_CANDIDATES_SQL + " SELECT candidate_id, complexity, metric FROM c WHERE EXISTS (SELECT 1 FROM c o WHERE o.metric <= c.metric AND o.complexity <= c.complexity AND (o.metric < c.metric OR o.complexity < c.complexity))")
def candidate_dominated(spark, d):
    return split.dominated(candidate_table(spark, d)).select("candidate_id", "complexity", "metric")


@query(_CANDIDATES_SQL + ", b AS (SELECT complexity, min(metric) AS metric, arg_min(candidate_id, (metric, candidate_id)) AS candidate_id FROM c GROUP BY 1) SELECT complexity, metric, candidate_id FROM (SELECT *, min(metric) OVER (ORDER BY complexity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b) WHERE p IS NULL OR metric < p")
def candidate_front(spark, d):
    return split.best_per_complexity(candidate_table(spark, d)).select("complexity", "metric", "candidate_id")


# graphs: nations as nodes, trade between a supplier's and a customer's nation as edges

_TRADE = "SELECT s_nationkey AS i, c_nationkey AS j, sum(l_extendedprice) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"
_GRAPH = f"WITH e AS ({_TRADE}), a AS (SELECT i, j FROM e WHERE (i + j) % 3 = 0), b AS (SELECT i, j FROM e WHERE (i * j) % 4 = 1), x AS (SELECT CAST(n_nationkey AS BIGINT) AS node, coalesce(m, 0) AS x FROM nation LEFT JOIN (SELECT c_nationkey, avg(c_acctbal)/1000 AS m FROM customer GROUP BY 1) ON n_nationkey = c_nationkey)"


def trade(spark, d) -> Graph:
    nation = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    customer = read(spark, d, "customer")
    mean = customer.groupBy(F.col("c_nationkey").cast("long").alias("node")).agg((F.avg("c_acctbal") / 1000).alias("x"))
    nodes = nation.join(mean, "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("x"))
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice")
    pairs = (
        lines.join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").cast("long").alias("i"), F.col("c_nationkey").cast("long").alias("j"))
        .agg(F.sum("l_extendedprice").alias("w"))
        .withColumn("row_id", F.col("i") * 25 + F.col("j"))
    )
    a, b = pairs.filter("(i + j) % 3 = 0"), pairs.filter("(i * j) % 4 = 1")
    third = a.join(a.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").filter("i < j and j < k").select((F.col("i") * 625 + F.col("j") * 25 + F.col("k")).alias("row_id"), "i", "j", "k")
    return Graph(25, nodes, {"A": a.select("row_id", "i", "j"), "B": b.select("row_id", "i", "j"), "T": third}, {"w": ("A", a.select("row_id", (F.col("w") / 1e6).alias("value")))})


def _graph_query(name: str, formula: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: told(parse(formula).evaluate(trade(spark, d)))
    ORACLES[name] = _GRAPH + " " + sql


_graph_query("graph_sum", "sum[j](A[i, j], x[j])", f"SELECT n.node AS i, {S('coalesce(sum(x.x), 0)')} AS value FROM x n LEFT JOIN a ON a.i = n.node LEFT JOIN x ON x.node = a.j GROUP BY 1")
_graph_query("graph_sum_mixed", "x[i] + sum[j](A[i, j], x[i] * x[j]) - 0.5 * sum[k](x[k])", f"SELECT n.node AS i, {S('n.x + n.x * coalesce(s, 0) - 0.5 * (SELECT sum(x) FROM x)')} AS value FROM x n LEFT JOIN (SELECT a.i, sum(x.x) AS s FROM a JOIN x ON x.node = a.j GROUP BY 1) t ON t.i = n.node")
_graph_query("graph_sum_fill", "sum[j](A[i, j] + 1, x[j])", f"SELECT n.node AS i, {S('coalesce(s, 0) + (SELECT sum(x) FROM x)')} AS value FROM x n LEFT JOIN (SELECT a.i, sum(x.x) AS s FROM a JOIN x ON x.node = a.j GROUP BY 1) t ON t.i = n.node")
_graph_query("graph_edge_field", "sum[j](A[i, j], w[i, j] * x[j])", f"SELECT n.node AS i, {S('coalesce(s, 0)')} AS value FROM x n LEFT JOIN (SELECT e.i, sum(e.w / 1e6 * x.x) AS s FROM e JOIN a USING (i, j) JOIN x ON x.node = e.j GROUP BY 1) t ON t.i = n.node")
_graph_query("graph_free_pair", "x[i] * x[j] - x[i]", f"SELECT p.node AS i, q.node AS j, {S('p.x * q.x - p.x')} AS value FROM x p, x q")
_graph_query("graph_gather", "gather(A[i, j], x[i] + x[j]) + w", f"SELECT i * 25 + j AS row_id, i, j, {S('p.x + q.x + e.w / 1e6')} AS value FROM e JOIN a USING (i, j) JOIN x p ON p.node = i JOIN x q ON q.node = j")
_graph_query("graph_gather_algebra", "gather(A[i, j] + 0.5 * B[i, j], x[i] - x[j])", f"SELECT i * 25 + j AS row_id, i, j, {S('m * (p.x - q.x)')} AS value FROM (SELECT i, j, (CASE WHEN a.i IS NULL THEN 0 ELSE 1 END) + (CASE WHEN b.i IS NULL THEN 0 ELSE 0.5 END) AS m FROM a FULL OUTER JOIN b USING (i, j)) JOIN x p ON p.node = i JOIN x q ON q.node = j")
_graph_query("graph_lifted", "sum[j](A[i, j], gather(A[i, j], x[i] + x[j])[i, j] * x[j])", f"SELECT n.node AS i, {S('coalesce(s, 0)')} AS value FROM x n LEFT JOIN (SELECT a.i, sum((p.x + q.x) * q.x) AS s FROM a JOIN x p ON p.node = a.i JOIN x q ON q.node = a.j GROUP BY 1) t ON t.i = n.node")
_graph_query("hyper_sum", "sum[j, k](T[i, j, k], x[i] * x[j] * x[k])", f"SELECT n.node AS i, {S('coalesce(s, 0)')} AS value FROM x n LEFT JOIN (SELECT p.i, sum(u.x * v.x * w.x) AS s FROM a p JOIN a q ON q.i = p.j JOIN x u ON u.node = p.i JOIN x v ON v.node = p.j JOIN x w ON w.node = q.j WHERE p.i < p.j AND p.j < q.j GROUP BY 1) t ON t.i = n.node")
_graph_query("graph_aggr_nested", "aggr(A, sour(aggr(A, targ(x) * sour(x))))", f", s AS (SELECT a.i, sum(p.x * q.x) AS s FROM a JOIN x p ON p.node = a.i JOIN x q ON q.node = a.j GROUP BY 1) SELECT n.node AS i, {S('coalesce(t, 0)')} AS value FROM x n LEFT JOIN (SELECT a.i, sum(coalesce(s.s, 0)) AS t FROM a LEFT JOIN s ON s.i = a.j GROUP BY 1) u ON u.i = n.node")
_graph_query("graph_independent", "x[i] + sum[j](A[i, j], x[i] * sum[k](x[k]) * x[j])", f"SELECT n.node AS i, {S('n.x + n.x * (SELECT sum(x) FROM x) * coalesce(s, 0)')} AS value FROM x n LEFT JOIN (SELECT a.i, sum(x.x) AS s FROM a JOIN x ON x.node = a.j GROUP BY 1) t ON t.i = n.node")
_graph_query("graph_separable", "sum[j](sin(x[j] - x[i]) + (x[j] - x[i]) ** 3 * x[j])", f"SELECT p.node AS i, {_S6.format('sum(sin(q.x - p.x) + (q.x - p.x) ** 3 * q.x)')} AS value FROM x p, x q GROUP BY 1")
QUERIES["graph_separable"] = lambda spark, d: parse("sum[j](sin(x[j] - x[i]) + (x[j] - x[i]) ** 3 * x[j])").evaluate(trade(spark, d)).select("i", F.format_string("%.5e", "value").cast("double").alias("value"))
_graph_query("sparse_union", "sum[j](A[i, j] + B[i, j], x[j])", f"SELECT n.node AS i, {S('coalesce(s, 0)')} AS value FROM x n LEFT JOIN (SELECT i, sum(m * x.x) AS s FROM (SELECT i, j, count(*) AS m FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2) JOIN x ON x.node = j GROUP BY 1) t ON t.i = n.node")
for _n in ("graph_aggr_nested",):
    ORACLES[_n] = ORACLES[_n].replace(" , s AS", ", s AS")


# series

_HOURLY = "SELECT epoch(date_trunc('hour', ts)) / 3600 AS t, sum(value) AS x FROM events GROUP BY 1"


@query(f"""WITH h AS ({_HOURLY}), seg AS (SELECT t, x, lead(t) OVER (ORDER BY t) AS t2, lead(x) OVER (ORDER BY t) AS x2 FROM h)
SELECT {S("h.t")} AS t, {S("h.x")} AS x, {S("CASE WHEN s.t2 IS NULL THEN s.x ELSE s.x + (s.x2 - s.x) * (h.t - 1.5 - s.t) / (s.t2 - s.t) END")} AS delayed FROM h LEFT JOIN seg s ON s.t <= h.t - 1.5 AND (h.t - 1.5 < s.t2)""")
def delay_interp(spark, d):
    hourly = events.read(spark, f"{d}/events.parquet", streaming=False).groupBy((F.date_trunc("hour", "ts").cast("double") / 3600).alias("t")).agg(F.sum("value").alias("x"))
    df, f = delays.attach_delays(hourly, parse("delay(x, 1.5)"), time="t")
    return told(df.select("t", "x", f.to_column().alias("delayed")))


@query(f"""WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, value AS x FROM events), s AS (SELECT user_id, t, x, lead(t) OVER w AS t2, lead(x) OVER w AS x2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, x)),
l AS (SELECT user_id, t, arg_max(x, x) AS x, max(t2) AS t2, arg_max(x2, t2) AS x2 FROM s GROUP BY 1, 2), q AS (SELECT *, t - 7200.5 AS q FROM e)
SELECT q.event_id, {S("CASE WHEN l.t = q.q THEN l.x WHEN l.t2 > l.t THEN l.x + (l.x2 - l.x) * (q.q - l.t) / (l.t2 - l.t) END")} AS delayed FROM q ASOF LEFT JOIN l ON q.user_id = l.user_id AND q.q >= l.t""")
def delay_by_user(spark, d):
    df = events.read(spark, f"{d}/events.parquet", streaming=False).select("event_id", "user_id", "value", F.col("ts").cast("double").alias("t"))
    return told(delays.delay(df, "value", 7200.5, time="t", by=("user_id",)).select("event_id", "delayed"))


@query(f"SELECT user_id, event_id, {S('lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id)')} AS delayed FROM events")
def delay_by_step(spark, d):
    return told(delays.by_step(read(spark, d, "events"), "value", 2, order="event_id", by=("user_id",)).select("user_id", "event_id", "delayed"))


# fits


@query(f"SELECT {S('regr_slope(l_extendedprice, l_quantity)')} AS slope, {S('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, count(*) AS n FROM lineitem")
def ols_fit(spark, d):
    g = fits.factor(read(spark, d, "lineitem"), {"x": F.col("l_quantity"), "y": F.col("l_extendedprice")})
    c, _ = g.solve()
    return _one(spark, {"slope": float(c[0]), "intercept": float(c[1]), "n": int(g.n)})


@query(f"SELECT {S('exp(regr_intercept(ln(l_extendedprice), ln(l_quantity)))')} AS scale, {S('regr_slope(ln(l_extendedprice), ln(l_quantity))')} AS exponent, count(*) AS n FROM lineitem")
def power_law_ols(spark, d):
    r = fits.power_law_fit(read(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", key="l_orderkey")
    return _one(spark, {"scale": r["scale"], "exponent": r["exponents"]["l_quantity"], "n": int(r["n"])})




@query(f"""WITH z AS (SELECT (l_quantity - m) / s AS a, l_extendedprice AS y, m, s FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)), g AS (SELECT count(*) AS n, avg(a*a) AS a2, avg(a*a*a) AS a3, avg(a*a*a*a) AS a4, avg(y) AS y0, avg(a*y) AS y1, avg(a*a*y) AS y2, max(m) AS m, max(s) AS s FROM z),
k AS (SELECT *, (y2 - a2*y0 - a3*y1/a2) / (a4 - a2*a2 - a3*a3/a2) AS c FROM g), b AS (SELECT *, (y1 - c*a3)/a2 AS b, y0 - c*a2 AS a0 FROM k)
SELECT {_S6.format("a0 - b*m/s + c*m*m/(s*s)")} AS c0, {_S6.format("b/s - 2*c*m/(s*s)")} AS c1, {_S6.format("c/(s*s)")} AS c2, n FROM b""")
def poly2_fit(spark, d):
    r = fits.polynomial_fit(read(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", degree=2, prune=False)
    c = r["coefficients"]
    six = lambda v: float(f"{v:.5e}")
    return spark.createDataFrame([(six(c["1"]), six(c["l_quantity"]), six(c["l_quantity**2"]), int(r["n"]))], "c0 double, c1 double, c2 double, n long")


_TERMS = {"p_retailprice": "p_retailprice", "l_quantity": "l_quantity", "p_retailprice**2": "p_retailprice * p_retailprice", "l_quantity*p_retailprice": "l_quantity * p_retailprice", "l_quantity**2": "l_quantity * l_quantity"}


@query(least_squares_sql(_TERMS, "y", "(SELECT l_extendedprice * (1 - l_discount) AS y, l_quantity, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey)", digits=7))
def polynomial_terms(spark, d):
    r = fits.polynomial_fit(lines(spark, d).withColumn("y", F.col("l_extendedprice") * (1 - F.col("l_discount"))), ["l_quantity", "p_retailprice"], "y", degree=2, prune=False)
    return spark.createDataFrame([(k, rounded(v, 7), rounded(r["std_errors"][k], 7)) for k, v in r["coefficients"].items()], "term string, coefficient double, std_error double")


_NEAR_SQL = """WITH d AS (SELECT l_quantity AS q, (l_quantity + 1e-3::DOUBLE * l_tax) - l_quantity AS t, l_extendedprice AS y FROM lineitem),
g AS (SELECT regr_slope(q, t) AS s, avg(q) AS mq, avg(t) AS mt, avg(y) AS my FROM d), r AS (SELECT q - mq - s * (t - mt) AS q, t - mt AS t, y - my AS y FROM d, g),
b AS (SELECT sum(q * y) / sum(q * q) AS bq, sum(t * y) / sum(t * t) AS bt FROM r),
c AS (SELECT bq AS whole, bt - bq * s AS second, my - bq * mq - (bt - bq * s) * mt AS first FROM b, g)"""


@query(f"{_NEAR_SQL} SELECT {_S6.format('whole - second')} AS a, {_S6.format('second')} AS b, {_S6.format('first')} AS c, CAST(2 AS BIGINT) AS rank FROM c")
def collinear_fit(spark, d):
    """Two features that differ by a thousandth of a third column; SQL fits that column itself and goes back."""
    df = read(spark, d, "lineitem")
    q = F.col("l_quantity")
    g = fits.factor(df, {"a": q, "b": q + 1e-3 * F.col("l_tax"), "y": F.col("l_extendedprice")})
    c, _ = g.solve()
    return spark.createDataFrame([(*(float(f"{v:.5e}") for v in c), g.rank)], "a double, b double, c double, rank long")


_LAW = "3 * l_discount + 2 * l_discount * l_quantity + 1"
_KEPT = {"l_discount": "l_discount", "l_quantity*l_discount": "l_quantity * l_discount"}


@query("SELECT term, CASE WHEN abs(coefficient - round(coefficient)) <= 0.005 THEN round(coefficient) ELSE coefficient END AS coefficient FROM (" + least_squares_sql(_KEPT, _LAW, "lineitem") + ")")
def stlsq_fit(spark, d):
    df = lines(spark, d).withColumn("target", parse(_LAW).to_column())
    found = fits.stlsq(df, fits.polynomial_library(["l_quantity", "l_discount"], 2), "target", threshold=0.5, alpha=1e-8)
    return spark.createDataFrame([(k, rounded(v)) for k, v in found.items()], "term string, coefficient double")


_RATIO = "(0.5 + 3 * (l_quantity / 50)) / (1 + 0.7 * (l_quantity / 50))"
_RATIO_SQL = least_squares_sql({"x": "x", "yx": "-y * x"}, "y", f"(SELECT l_quantity / 50 AS x, {_RATIO} AS y FROM lineitem WHERE {CHANCE.format(key='l_orderkey', seed=0)} >= 0.2)")


@query(f"SELECT CASE term WHEN 'yx' THEN 'q' ELSE 'p' END AS part, CAST(CASE term WHEN '1' THEN 0 ELSE 1 END AS BIGINT) AS power, coefficient FROM ({_RATIO_SQL}) UNION ALL SELECT 'q', 0, 1.0")
def rational_fit(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 50).alias("x0"), parse(_RATIO).to_column().alias("y0"))
    r = fits.rational_fit(df, "x0", "y0", key="l_orderkey")
    return spark.createDataFrame([(k, i, rounded(v)) for k in "pq" for i, v in enumerate(r[k])], "part string, power long, coefficient double")


_WAVE = "2 + 0.5 * l_quantity + 1.5 * l_quantity * sin(3 * (l_discount * 10))"
_WAVE_SQL = least_squares_sql({"b": "l_quantity", "c": "l_quantity * sin(3 * (l_discount * 10))"}, _WAVE, "lineitem")


@query(f"SELECT 3.0 AS omega, max(coefficient) FILTER (term = '1') AS a, max(coefficient) FILTER (term = 'b') AS b, max(coefficient) FILTER (term = 'c') AS c FROM ({_WAVE_SQL})")
def harmonic_fit(spark, d):
    df = read(spark, d, "lineitem").select("l_quantity", "l_tax", parse(_WAVE).to_column().alias("y"), (F.col("l_discount") * 10).alias("t"))
    r = fits.harmonic_fit(df, "l_quantity", "t", "y", frequencies=[1.0 + 0.5 * k for k in range(9)])
    return spark.createDataFrame([tuple(rounded(r[k]) for k in ("omega", "a", "b", "c"))], "omega double, a double, b double, c double")


_GROWTH = ["s0 AS (SELECT CAST(20.0 AS DOUBLE) AS a, CAST(0.02 AS DOUBLE) AS b)"]
for _k in range(15):  # steps of Gauss and Newton
    _GROWTH.append(f"n{_k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * r) AS ur, sum(v * r) AS vr FROM (SELECT a, b, exp(b * x) AS u, a * x * exp(b * x) AS v, y - a * exp(b * x) AS r FROM t, s{_k}))")
    _GROWTH.append(f"s{_k + 1} AS MATERIALIZED (SELECT a + (ur * vv - vr * uv) / (uu * vv - uv * uv) AS a, b + (vr * uu - ur * uv) / (uu * vv - uv * uv) AS b FROM n{_k})")


@query(f"WITH t AS MATERIALIZED (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), {', '.join(_GROWTH)} SELECT {_S6.format('a')} AS a, {_S6.format('b')} AS b FROM s15")
def lm_fit(spark, d):
    df = read(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    r = nonlinear.fit("param('a', value=20.0) * exp(param('b', value=0.02) * l_quantity)", df, "y")
    return spark.createDataFrame([(rounded(r.parameters["a"]), rounded(r.parameters["b"]))], "a double, b double")


_PULL = "SELECT n.node AS i, n.x AS x, coalesce(s, 0) AS s, n.x * n.x AS xx FROM x n LEFT JOIN (SELECT a.i, sum(x.x - p.x) AS s FROM a JOIN x ON x.node = a.j JOIN x p ON p.node = a.i GROUP BY 1) t ON t.i = n.node"


@query(f"{_GRAPH} SELECT {S('(sys * sxx - sxy * sxs) / (sss * sxx - sxs * sxs)')} AS pull, {S('(sxy * sss - sys * sxs) / (sss * sxx - sxs * sxs)')} AS own FROM (SELECT sum(s * xx) AS sys, sum(x * xx) AS sxy, sum(s * s) AS sss, sum(x * x) AS sxx, sum(x * s) AS sxs FROM ({_PULL}))")
def graph_fit(spark, d):
    """Two parameters of a formula with a sum over neighbours, against their normal equations."""
    g = trade(spark, d)
    held = Graph(g.num_nodes, g.nodes.withColumn("y", F.col("x") * F.col("x")), g.relations)
    r = nonlinear.fit("param('own') * x[i] + param('pull') * sum[j](A[i, j], x[j] - x[i])", held, "y")
    return _one(spark, {k: r.parameters[k] for k in ("pull", "own")})


@query(f"SELECT l_returnflag AS category, {S('sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity)')} AS slope FROM lineitem GROUP BY 1")
def grouped_fit(spark, d):
    r = nonlinear.fit("grouped_param(l_returnflag, name='slope') * l_quantity", read(spark, d, "lineitem"), "l_extendedprice")
    return told(spark.createDataFrame(list(r.parameters["slope"].items()), "category string, slope double"))


@query(f"""WITH g AS (SELECT l_partkey AS category, sum(l_quantity * l_quantity) AS c, sum(l_quantity * l_tax) AS b, sum(l_quantity * l_extendedprice) AS q, sum(l_tax * l_tax) AS a, sum(l_tax * l_extendedprice) AS t FROM lineitem GROUP BY 1),
s AS (SELECT sum(t - b * q / c) / sum(a - b * b / c) AS tax FROM g) SELECT category, {_S6.format("(q - b * tax) / c")} AS slope, {_S6.format("tax")} AS tax FROM g, s""")
def grouped_shared_fit(spark, d):
    """A slope for each part and a parameter that all share, against the elimination in SQL."""
    df = read(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_tax", "l_extendedprice")
    r = nonlinear.fit("grouped_param(l_partkey, name='slope') * l_quantity + param('tax') * l_tax", df, "l_extendedprice")
    six = lambda c: F.format_string("%.5e", c).cast("double")
    return r.groups.select("category", six(F.col("slope")).alias("slope"), six(F.lit(r.parameters["tax"])).alias("tax"))


_HELD = f"{CHANCE.format(key='l_orderkey', seed=0)} < 0.2"


@query(f"""WITH t AS MATERIALIZED (SELECT {_HELD} AS held, l_quantity AS q, l_tax AS t, l_extendedprice AS y FROM lineitem),
m AS (SELECT avg(q) AS mq, avg(t) AS mt, avg(y) AS my, var_pop(q) AS qq, var_pop(t) AS tt, covar_pop(q, t) AS qt, covar_pop(q, y) AS qy, covar_pop(t, y) AS ty FROM t WHERE NOT held),
c AS (SELECT *, (qy * tt - ty * qt) / (qq * tt - qt * qt) AS a, (ty * qq - qy * qt) / (qq * tt - qt * qt) AS b FROM m)
SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS split, count(*) AS n, round(1 - sum((y - my - a * (q - mq) - b * (t - mt)) ** 2) / (var_pop(y) * count(*)), 9) AS r2, CAST(9 AS BIGINT) AS complexity FROM t, c GROUP BY held""")
def evaluate_formula(spark, d):
    """A candidate with unknown constants: fitted on the train rows, scored on both sides."""
    from ..operators.evaluators import Evaluator
    from ..sources.dataset import Dataset

    data = Dataset(read(spark, d, "lineitem"), "l_extendedprice")
    got = Evaluator(options={"key": "l_orderkey"}).evaluate_candidate(data, "a * l_quantity + b * l_tax + c")
    return spark.createDataFrame([(s, m["n"], round(m["r2"], 9), got["complexity"]) for s, m in got["metrics"].items()], "split string, n long, r2 double, complexity long")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders) AND o_custkey % 7 = 1 AND o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)")
def filtered_orders(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    half = ranges.quantiles(df, {"half": (F.col("o_totalprice"), [0.5])})["half"][0]
    return df.filter("o_custkey % 7 = 1").filter(F.col("o_totalprice") > F.lit(half)).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42') LIMIT 500")
def subsample(spark, d):
    from ..operators.evaluators import subsample

    return subsample(read(spark, d, "orders"), 500, key="o_orderkey").select("o_orderkey", "o_totalprice")


_ROUGH = "1.42 * p_retailprice - 0.74"
_PICKS = [[("", x.value), *constants.nearby_constants(float(x.value))] for x in parse(_ROUGH).iter_preorder() if isinstance(x, Number)]
_PICKS_SQL = ", ".join(f"('{a},{b}', {int(bool(a)) + int(bool(b))}, CAST({v!r} AS DOUBLE), CAST({w!r} AS DOUBLE))" for a, v in _PICKS[0] for b, w in _PICKS[1])


@query(f"""WITH t AS (SELECT p_retailprice AS p, p_retailprice * sqrt(2) - 0.75 AS y FROM part), m AS (SELECT avg(y) AS m, var_pop(y) * count(*) AS total FROM t),
c AS (SELECT choices, CAST(simple AS BIGINT) AS simple, 1 - sum((y - (v * p - w)) ** 2) / any_value(total) AS r2 FROM (VALUES {_PICKS_SQL}) AS k(choices, simple, v, w), t, m GROUP BY ALL),
b AS (SELECT simple, max(r2) AS r2, arg_max(choices, (r2, choices)) AS choices FROM c GROUP BY 1)
SELECT choices, simple, round(r2, 9) AS r2 FROM (SELECT *, max(r2) OVER (ORDER BY simple DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) WHERE before IS NULL OR r2 > before""")
def constant_fit(spark, d):
    df = read(spark, d, "part").withColumn("y", F.col("p_retailprice") * math.sqrt(2) - 0.75)
    front = constants.constant_fit(_ROUGH, df, "y")
    return spark.createDataFrame([(",".join(c or "" for c in m["choices"]), m["simple"], round(m["r2"], 9)) for m in front], "choices string, simple long, r2 double")


_RISKY = "l_quantity / (l_extendedprice - l_quantity * 900) + l_quantity"
#: The formula without each node in turn; of IEEE, where a divisor is zero.
_RISKY_SQL = {"root": "0.0", "root/0": "q", "root/0/0": "0.0 / (p - q * 900) + q", "root/0/1": "NULL", "root/0/1/0": "q / (0 - q * 900) + q", "root/0/1/1": "q / p + q", "root/0/1/1/0": "q / p + q", "root/0/1/1/1": "q / p + q", "root/1": "q / (p - q * 900)"}
_RISKY_NODES = {"/".join(["root", *map(str, k)]): str(x) for k, x in constants.places(parse(_RISKY))}


@query(
    "WITH t AS (SELECT q, p, CASE WHEN p <> q * 900 THEN q / (p - q * 900) + q END AS whole FROM (SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem)) "
    + " UNION ALL ".join(f"SELECT '{k}' AS path, '{_RISKY_NODES[k]}' AS node, round(sqrt(avg((r - whole) ** 2) / avg(CASE WHEN r IS NOT NULL THEN whole * whole END)), 6) AS impact FROM (SELECT whole, CASE WHEN whole IS NOT NULL AND isfinite({v}) THEN {v} END AS r FROM t)" for k, v in _RISKY_SQL.items())
)
def eic(spark, d):
    """How much each part of a formula matters; the digits that it loses are drawn, so they aren't told here."""
    rows = noise.noise_amplification(_RISKY, read(spark, d, "lineitem"), repeats=2)
    return spark.createDataFrame([(r["path"], r["node"], None if r["impact"] is None else round(r["impact"], 6)) for r in rows], "path string, node string, impact double")


_SEARCHED = ["l_quantity", "p_retailprice", "l_discount"]
_SEARCH_SQL = " UNION ALL ".join(
    f"SELECT '{e}' AS formula, CAST({len(e)} AS BIGINT) AS complexity, CASE WHEN var_pop(v) > 1e-20 * avg(v * v) THEN regr_r2(y, v) END AS r2 FROM (SELECT y, CASE WHEN isfinite({to_sql(e)}) THEN {to_sql(e)} END AS v FROM l)"
    for e in nonlinear.enumerate_formulas(_SEARCHED, most=100)
)


@query(f"WITH l AS MATERIALIZED (SELECT l_extendedprice AS y, CAST(l_quantity AS DOUBLE) AS l_quantity, p_retailprice, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT formula, complexity, {S('r2')} AS r2 FROM ({_SEARCH_SQL}) WHERE isfinite(r2) ORDER BY round(r2, 9) DESC, complexity, formula LIMIT 5")
def formula_search(spark, d):
    found = nonlinear.search(lines(spark, d), _SEARCHED, "l_extendedprice")[:5]
    return told(spark.createDataFrame([(m["formula"], m["complexity"], m["r2"]) for m in found], "formula string, complexity long, r2 double"))


@query(f"""WITH e AS (SELECT DISTINCT user_id, epoch(ts) / 86400 AS s FROM events), f AS (SELECT user_id, s - min(s) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM e),
x AS (SELECT user_id, t, n, (1 + user_id % 5) * exp(-0.4 * t) + t AS x FROM f WHERE n > 1) SELECT user_id, count(*) AS n, {_S6.format("avg(x)")} AS mean, {_S6.format("arg_max(x, t)")} AS last FROM x GROUP BY 1""")
def ode_rollout(spark, d):
    """Each user's events as the times at which a law's trajectory, of another start for each user, is observed; SQL has its closed form."""
    times = read(spark, d, "events").select("user_id", (F.col("ts").cast("timestamp").cast("double") / 86400).alias("at")).distinct()
    first = times.groupBy("user_id").agg(F.min("at").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    rows = times.join(first, "user_id").select("user_id", (F.col("at") - F.col("first")).alias("t"))
    rows = rows.withColumn("x", F.when(F.col("t") == 0, 1.0 + F.col("user_id") % 5).otherwise(float("nan")))  # the start alone is given
    got = rollout.rollouts(rows, "1 - 0.4 * (x - t)", by="user_id", rtol=1e-12, atol=1e-12)
    six = lambda c: F.format_string("%.5e", c).cast("double")
    return got.groupBy("user_id").agg(F.count("*").alias("n"), six(F.avg("rolled")).alias("mean"), six(F.max_by("rolled", "t")).alias("last"))


# streams, as what they come to


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, " + S("sum(value)") + " AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return told(events.tumbling(events.read(spark, f"{d}/events.parquet", streaming=False))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1")
def sliding_windows(spark, d):
    return events.sliding(events.read(spark, f"{d}/events.parquet", streaming=False)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    df = events.sessions(events.read(spark, f"{d}/events.parquet", streaming=False))
    return df.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query(f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, count(value) AS finite, {S("min(value)")} AS min, {S("max(value)")} AS max, {S("avg(value)")} AS mean, {S("var_pop(value)")} AS variance FROM events GROUP BY 1, 2""")
def running_profile(spark, d):
    return told(events.running_profile(events.read(spark, f"{d}/events.parquet", streaming=False))).withColumn("start", F.col("start").cast("timestamp_ntz"))


_TIMELINE = "SELECT event_id AS seq, user_id AS response_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'delta' END AS kind, event_type AS payload FROM events"


@query(f"""WITH e AS ({_TIMELINE}) SELECT response_id, max(seq) AS seq, CASE WHEN count(*) FILTER (kind='done') > 0 THEN 'done' ELSE 'delta' END AS kind, arg_max(payload, (CASE WHEN kind='done' THEN 1 ELSE 0 END, seq)) AS payload, count(*) FILTER (kind='done') > 0 AS ended FROM e GROUP BY 1""")
def event_compaction(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("response_id"), F.when(F.col("event_type") == "purchase", "done").otherwise("delta").alias("kind"), F.col("event_type").alias("payload"))
    return events.compacted(e)


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id > greatest(20, (SELECT max(event_id) - 1000 FROM events)) ORDER BY seq LIMIT 32")
def event_page(spark, d):
    return events.page(read(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"), 20)[0]


@query("""WITH e AS (SELECT user_id, CAST(event_id AS VARCHAR) AS event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), CAST(event_id AS VARCHAR)) AS seq FROM events)
SELECT user_id, event_id, seq, greatest(seq - 8, 0) AS discarded_through, CAST(least(seq, 8) AS INTEGER) AS held, greatest(seq - 7, 1) AS oldest FROM e""")
def event_ring(spark, d):
    """Each user's events as they enter a ring of eight."""
    df = events.read(spark, f"{d}/events.parquet", streaming=False)
    own = df.select("user_id", "event_id", "ts", F.col("event_type").alias("kind"), F.lit(None).cast("string").alias("response_id"), F.col("event_type").alias("payload"))
    return ring.timelines(own, "user_id", capacity=8).select("user_id", "event_id", "seq", "discarded_through", "held", "oldest")


# text


@query(r"""SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_lines, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_characters FROM documents""")
def text_wc(spark, d):
    return text.wc(read(spark, d, "documents"), "doc_id")


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


@query(f"SELECT doc_id, count(*) AS n FROM {_LINES} WHERE regexp_matches(line, '(?i)licen[sc]e') GROUP BY 1")
def text_grep(spark, d):
    return text.grep_count(text.lines(read(spark, d, "documents"), "doc_id"), "doc_id", "licen[sc]e", ignore_case=True)


@query(f"SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM {_LINES} WHERE n <= 2")
def text_head(spark, d):
    return text.head(text.lines(read(spark, d, "documents"), "doc_id"), "doc_id", 2)


@query(f"SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM {_LINES}) WHERE n > m - 1")
def text_tail(spark, d):
    return text.last_lines(read(spark, d, "documents"), "doc_id", 1)


@query("SELECT page_id, coalesce(string_split(url, '/')[3], '') || '/' || coalesce(string_split(url, '/')[9], '') AS line FROM pages")
def text_cut(spark, d):
    return text.cut(read(spark, d, "pages").select("page_id", F.col("url").alias("line")), [3, 9], delimiter="/")


@query("SELECT DISTINCT source AS line FROM documents")
def text_sort_unique(spark, d):
    return text.sort(read(spark, d, "documents").select(F.col("source").alias("line")), unique=True, reverse=True)


_BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
_SHOWN = _BARE
for _e, _c in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _SHOWN = f"replace({_SHOWN}, '{_e}', '{_c}')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_SHOWN}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM pages")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_join(spark, d):
    from ..sources.dataset import Dataset

    poor = read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return Dataset(read(spark, d, "orders"), "o_totalprice").semi(poor, "o_custkey").frame.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def anti_join(spark, d):
    from ..sources.dataset import Dataset

    poor = read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return Dataset(read(spark, d, "orders"), "o_totalprice").anti(poor, "o_custkey").frame.select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue, floor(ln(l_extendedprice) * 1e6 + 0.5) / 1e6 AS log_price FROM lineitem")
def derived_features(spark, d):
    from ..sources.dataset import Dataset

    ds = Dataset(read(spark, d, "lineitem"), "l_extendedprice").add_features({"revenue": "l_extendedprice * (1 - l_discount)", "log_price": "ln(l_extendedprice)"})
    return ds.frame.select("l_orderkey", "l_linenumber", "revenue", six(F.col("log_price")).alias("log_price"))
