"""Relationship mining over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators import correlations as cor
from plumbline.operators import relationships as rel
from plumbline.operators.equations import validate_equations
from plumbline.operators.lasso import fit_cross_validated, fit_fixed_alpha
from verification.fixtures import frame, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register


_CATEGORIES = ["nation", "region", "weight", "segment", "balance", "wealth"]


def _head(*names: str) -> str:
    return with_fixtures("SELECT 1", *names).rsplit("SELECT 1", 1)[0].rstrip()


def _pairs() -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(_CATEGORIES) for b in _CATEGORIES[i + 1:]]


_TABLE = "cells AS (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, {a}::VARCHAR AS a, {b}::VARCHAR AS b, count(*) AS n FROM categories "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for a, b in _pairs()) + ")"
# Expected counts over the full grid of values, empty cells included.
_V = """v AS (
    SELECT col1, col2, CASE WHEN least(r, k) <= 1 THEN 0.0 ELSE sqrt(chi2 / (total * (least(r, k) - 1))) END AS cramers_v FROM (
      SELECT g.col1, g.col2, max(g.total)::DOUBLE AS total, count(DISTINCT g.a) AS r, count(DISTINCT g.b) AS k,
             sum(pow(CASE WHEN g.grid = 4 AND g.rows = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE o - e END, 2) / e) AS chi2
      FROM (SELECT x.col1, x.col2, x.a, y.b, x.total, x.n::DOUBLE * y.n / x.total AS e, coalesce(c.n, 0)::DOUBLE AS o,
                   count(*) OVER (PARTITION BY x.col1, x.col2) AS grid, x.rows
            FROM (SELECT col1, col2, a, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY col1, col2) AS total,
                         count(*) OVER (PARTITION BY col1, col2) AS rows FROM cells GROUP BY col1, col2, a) x
            JOIN (SELECT col1, col2, b, sum(n) AS n FROM cells GROUP BY col1, col2, b) y USING (col1, col2)
            LEFT JOIN cells c ON c.col1 = x.col1 AND c.col2 = x.col2 AND c.a = x.a AND c.b = y.b) g
      GROUP BY g.col1, g.col2))"""


@query("n1_low_cardinality", _head("categories") + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM categories HAVING count(DISTINCT {c}) <= 100" for c in [*_CATEGORIES, "c_custkey"]))
def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.low_cardinality_columns(frame(spark, sf_dir, "categories"))


def _contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.contingency(frame(spark, sf_dir, "categories"), _CATEGORIES)


@query("n2_cramers_v", f"{_head('categories')}, {_TABLE}, {_V} SELECT col1, col2, round(cramers_v, 6) AS cramers_v FROM v")
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.cramers_v(_contingency(spark, sf_dir)).withColumn("cramers_v", F.round("cramers_v", 6))


@query("n3_strong_pairs", f"{_head('categories')}, {_TABLE}, {_V} SELECT col1, col2, round(cramers_v, 6) AS cramers_v FROM v WHERE cramers_v >= 0.5")
def strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rel.cramers_v(_contingency(spark, sf_dir))
    return rel.strong_pairs(v).withColumn("cramers_v", F.round("cramers_v", 6))


@query("n4_if_then_rules", f"""{_head('categories')}, {_TABLE}, {_V}
    SELECT 'categories' AS dataset_name, col1 AS if_col, a AS if_val, col2 AS then_col, b AS then_val, round(n / total, 3) AS confidence, round(cramers_v, 2) AS score,
           col1 || ',' || col2 AS columns
    FROM (SELECT col1, col2, a, b, n::DOUBLE AS n, sum(n) OVER (PARTITION BY col1, col2, a) AS total,
                 row_number() OVER (PARTITION BY col1, col2, a ORDER BY n DESC, b) AS rn FROM cells) JOIN v USING (col1, col2)
    WHERE rn = 1 AND n / total >= 0.7 AND cramers_v >= 0.5""")
def if_then_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rel.mine_categorical_rules(frame(spark, sf_dir, "categories"), "categories", _CATEGORIES)
    return rules.withColumn("columns", F.array_join("columns", ","))


_NUMBERS = ["l_quantity", "l_extendedprice", "price_line", "minus_quantity", "triple_quantity", "quantity_sum", "l_discount"]
_NUMBER_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1:]]


def _corr_sql(digits: int) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), {digits}) AS correlation FROM lines" for a, b in _NUMBER_PAIRS)


@query("n5_correlation_matrix", with_fixtures(_corr_sql(6), "lines"))
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = cor.correlation_matrix(frame(spark, sf_dir, "lines"), _NUMBERS)
    return matrix.withColumn("correlation", F.round("correlation", 6))


def _line_sql(x: str, y: str, sign: int) -> str:
    return f"""SELECT '{y}' AS target_variable, '{x}' AS feature_variable, {sign} * stddev_pop({y}) / stddev_pop({x}) AS a,
        avg({y}) - {sign} * stddev_pop({y}) / stddev_pop({x}) * avg({x}) AS b FROM lines WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""


@query("n6_line_equations", with_fixtures(f"""
    SELECT target_variable, feature_variable, round(a, 4) + 0.0::DOUBLE AS slope, round(b, 4) + 0.0::DOUBLE AS intercept,
           CASE WHEN abs(a - 1) < 1e-6 AND abs(b) < 1e-6 THEN 'direct' WHEN abs(a + 1) < 1e-6 AND abs(b) < 1e-6 THEN 'inverse' ELSE 'scaled' END AS relationship_type
    FROM ({_line_sql("l_quantity", "minus_quantity", -1)} UNION ALL {_line_sql("l_quantity", "triple_quantity", 1)}
          UNION ALL {_line_sql("l_quantity", "quantity_sum", 1)} UNION ALL {_line_sql("l_extendedprice", "price_line", 1)})""", "lines"))
def line_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cor.line_equations(frame(spark, sf_dir, "lines"), _NUMBERS)
    # Equations carry six decimals of a floating sum; slopes are compared rounded.
    return lines.select("target_variable", "feature_variable", (F.round("slope", 4) + 0.0).alias("slope"),
                        (F.round("intercept", 4) + 0.0).alias("intercept"), "relationship_type")


@query("n7_correlated_features", with_fixtures(f"""
    SELECT t AS target_variable, f AS feature, round(correlation, 4) AS correlation FROM (
      SELECT col1 AS t, col2 AS f, correlation FROM ({_corr_sql(12)}) UNION ALL SELECT col2, col1, correlation FROM ({_corr_sql(12)}))
    WHERE abs(correlation) >= 0.9 AND abs(correlation) < 0.9999""", "lines"))
def correlated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cor.correlated_features(cor.correlation_matrix(frame(spark, sf_dir, "lines"), _NUMBERS), 0.9)


def _descent(terms: list[str], target: str, alpha: str, sweeps: int = 400) -> str:
    """Coordinate descent in SQL: tables ``t`` (all rows), ``m`` (moments of the training rows) and ``w`` (coefficients, intercept).

    Rows train whose order key is below 70 modulo 100, as in the query.
    """
    k = range(len(terms))
    columns = ", ".join(f"({t})::DOUBLE AS x{i}" for i, t in enumerate(terms))
    finite = " AND ".join(f"isfinite(x{i})" for i in k)
    moments = ", ".join([f"avg(x{i}) AS a{i}, covar_pop(x{i}, y) AS c{i}y" for i in k]
                        + [f"covar_pop(x{min(i, j)}, x{max(i, j)}) AS c{i}_{j}" for i in k for j in k])
    inner = f"(SELECT * FROM cd, m WHERE i < {sweeps})"
    for j in k:
        rest = f"c{j}y" + "".join(f" - c{j}_{i} * {'v' if i < j else 'w'}{i}" for i in k if i != j)
        inner = f"(SELECT *, sign({rest}) * greatest(abs({rest}) - alpha, 0) / c{j}_{j} AS v{j} FROM {inner})"
    start = ", ".join(f"0.0::DOUBLE AS w{i}" for i in k)
    moved = ", ".join(f"v{i}" for i in k)
    weights = ", ".join(f"w{i}" for i in k)
    line = " - ".join(["ay", *[f"w{i} * a{i}" for i in k]])
    prediction = " + ".join(["b", *[f"w{i} * x{i}" for i in k]])
    return f"""t AS (SELECT * FROM (SELECT {columns}, {target}::DOUBLE AS y, l_orderkey % 100 AS part FROM lines) WHERE {finite} AND isfinite(y)),
        m0 AS (SELECT count(*) AS n, avg(y) AS ay, {moments} FROM t WHERE part < 70),
        m AS (SELECT *, ({alpha})::DOUBLE AS alpha FROM m0),
        cd AS (SELECT 0 AS i, {start} UNION ALL SELECT i + 1, {moved} FROM {inner}),
        w AS (SELECT {weights}, {line} AS b, alpha FROM cd, m WHERE i = {sweeps}),
        p AS (SELECT t.*, {prediction} AS p FROM t, w)"""


_RECURSIVE = with_fixtures("SELECT 1", "lines").rsplit("SELECT 1", 1)[0].rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ", "
_FIXED = ["l_quantity", "l_discount", "l_linenumber"]


def _certified(model: DataFrame) -> Column:
    """No coefficients lower the penalised error by more than a billionth of what the target's spread allows."""
    return ((F.col("duality_gap") < 1e-6) & (F.col("kkt_residual") < 1e-5)).alias("certified")


@query("n8_lasso_fixed_alpha", _RECURSIVE + _descent(_FIXED, "quantity_sum", "0.001") + """
    SELECT round(w0, 4) + 0.0 AS quantity, round(w1, 3) + 0.0 AS discount, round(w2, 4) + 0.0 AS linenumber, round(b, 3) + 0.0 AS intercept, TRUE AS certified,
           (SELECT round((1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))) * 100, 2) FROM p WHERE part >= 70) AS r2,
           (SELECT round(sum(abs(y - p)) / sum(y) * 100, 3) FROM p WHERE part >= 70) AS wmape,
           (SELECT round(avg(abs(y - p) / abs(y)) * 100, 3) FROM p WHERE part >= 70) AS mape,
           (SELECT round((1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))) * 100, 2) FROM p) AS r2_all,
           (SELECT count(*) FROM p) AS total_data,
           (SELECT round(count(*) FILTER (WHERE abs(y - p) <= 0.01 * s) * 100.0 / count(*), 2)::DOUBLE FROM p, (SELECT stddev_pop(y) AS s FROM p)) AS accuracy
    FROM w""")
def lasso_fixed_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = fit_fixed_alpha(frame(spark, sf_dir, "lines"), _FIXED, "quantity_sum", split=F.col("l_orderkey") % 100)
    c = F.col("coefficients")
    return fit.select(
        (F.round(c["l_quantity"], 4) + 0.0).alias("quantity"), (F.round(c["l_discount"], 3) + 0.0).alias("discount"),
        (F.round(c["l_linenumber"], 4) + 0.0).alias("linenumber"), (F.round("intercept", 3) + 0.0).alias("intercept"), _certified(fit),
        "r2", F.round("wmape", 3).alias("wmape"), F.round("mape", 3).alias("mape"), "r2_all", "total_data", "accuracy",
    )


# The target follows exactly from a term, so the smallest of the penalties tried, a thousandth of the largest, errs least.
_TERMS = ["l_quantity", "l_tax", "l_quantity * l_tax"]
_LARGEST = "greatest(" + ", ".join(f"abs(c{i}y)" for i in range(len(_TERMS))) + ") * 1e-3"


@query("n9_lasso_cross_validated", _RECURSIVE + _descent(_TERMS, "triple_quantity", _LARGEST) + """
    SELECT round(w0, 2) + 0.0 AS quantity, round(w1, 2) + 0.0 AS tax, round(w2, 2) + 0.0 AS product, round(b, 2) + 0.0 AS intercept, round(alpha, 5) AS alpha, TRUE AS certified,
           (SELECT round((1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))) * 100, 2) FROM p WHERE part >= 70) AS r2_test,
           (SELECT round(avg(abs(y - p) / abs(y)) * 100, 1) FROM p WHERE part >= 70) AS mape_test,
           (SELECT count(*) FROM p) AS data_points
    FROM w""")
def lasso_cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = {"quantity": F.col("l_quantity"), "tax": F.col("l_tax"), "product": F.col("l_quantity") * F.col("l_tax")}
    fit = fit_cross_validated(frame(spark, sf_dir, "lines"), ["l_quantity", "l_tax"], "triple_quantity", terms=terms, split=F.col("l_orderkey") % 100)
    c = F.col("coefficients")
    return fit.select(
        *[(F.round(c[t], 2) + 0.0).alias(t) for t in terms], (F.round("intercept", 2) + 0.0).alias("intercept"), F.round("alpha", 5).alias("alpha"),
        _certified(fit), "r2_test", F.round("mape_test", 1).alias("mape_test"), "data_points",
    )


_EQUATIONS = {
    "price_line = 2 * l_extendedprice + 1": ("price_line", "2 * l_extendedprice + 1", "price_line IS NOT NULL"),
    "triple_quantity = l_quantity * 3": ("triple_quantity", "l_quantity * 3", "triple_quantity IS NOT NULL"),
    "quantity_sum = l_quantity + 1": ("quantity_sum", "l_quantity + 1", "TRUE"),
    "l_quantity = l_extendedprice / l_discount": ("l_quantity", "l_extendedprice / nullif(l_discount, 0)", "TRUE"),
    "minus_quantity = -(l_quantity)": ("minus_quantity", "-l_quantity", "TRUE"),
}
_BROKEN = {
    "no equals sign": ("Invalid equation format (no equals sign)", "0"),
    "nothing = l_quantity": ("Target column 'nothing' not found", "(SELECT count(*) FROM lines)"),
    "l_tax = l_quantity + unknown_column": ("Expression evaluation error: name 'unknown_column' is not defined", "(SELECT count(*) FROM lines)"),
}


def _equation_sql(text: str, target: str, predicted: str, present: str) -> str:
    return f"""
    SELECT '{text}' AS equation, ok * 100.0 / n >= 90 AS valid, round(ok * 100.0 / n, 2)::DOUBLE AS satisfaction_rate, n AS total_records, ok AS satisfied_records,
           CASE WHEN ok * 100.0 / n < 90 THEN printf('Only %.2f%% records satisfy the equation', ok * 100.0 / n) END AS error_message
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE abs({target} - ({predicted})) <= greatest(0.01 * abs({target}), 1e-6)) AS ok FROM lines WHERE {present})"""


@query("n10_equation_validation", with_fixtures("\nUNION ALL\n".join(
    [_equation_sql(t, *e) for t, e in _EQUATIONS.items()]
    + ["SELECT '" + t + "', FALSE, 0.0::DOUBLE, " + n + "::BIGINT, 0::BIGINT, '" + m.replace("'", "''") + "'" for t, (m, n) in _BROKEN.items()]), "lines"))
def equation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_equations(frame(spark, sf_dir, "lines"), [*_EQUATIONS, *_BROKEN], 0.01)
