"""Sparse linear equations between numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.local import local_frame
from plumbline.model import quoted

_EPS = float(np.finfo(float).eps)
MODEL_SCHEMA = (
    "features array<string>, target string, equation string, intercept double, "
    "coefficients map<string,double>, alpha double, r2 double, wmape double, mape double, "
    "intercept_contribution double, r2_all double, wmape_all double, mape_all double, "
    "total_data bigint, accuracy double, duality_gap double, kkt_residual double, status string, message string"
)


@dataclass(frozen=True)
class Terms:
    """Model terms by name, over the columns of the data."""

    columns: Mapping[str, Column]
    base: tuple[str, ...]


def base_terms(features: Sequence[str]) -> Terms:
    return Terms({f: F.col(quoted(f)).cast("double") for f in features}, tuple(features))


def extended_terms(features: Sequence[str], products_up_to: int = 5, ratios_up_to: int = 4) -> Terms:
    """Features, their products where there are at most ``products_up_to``, their ratios likewise."""
    base = base_terms(features)
    terms = dict(base.columns)
    pairs = list(combinations(features, 2))
    if len(features) <= products_up_to:
        terms |= {f"{a}*{b}": base.columns[a] * base.columns[b] for a, b in pairs}
    if len(features) <= ratios_up_to:
        terms |= {f"{a}/{b}": F.try_divide(base.columns[a], base.columns[b]) for a, b in pairs}
    return Terms(terms, base.base)


def model_frame(df: DataFrame, terms: Terms, target: str, split: Column | None = None) -> DataFrame:
    """``x0.., y, part``: complete finite rows with a place in the split.

    Without a ``split`` of its own, whole numbers from 0 to 99, it is a hash of
    the row, so a lost task recomputes to the same side.  Values 0-69 of ``part``
    train, 70-99 test.
    """
    xs = {f"x{i}": c for i, c in enumerate(terms.columns.values())}
    frame = df.select(*[c.alias(n) for n, c in xs.items()],
                      F.col(quoted(target)).cast("double").alias("y"), (F.lit(None) if split is None else split).cast("bigint").alias("given"))
    finite = reduce(
        lambda a, b: a & b,
        [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")) for n in [*xs, "y"]],
    )
    part = F.pmod(F.xxhash64(F.lit(42), *[F.col(n) for n in [*xs, "y"]]), F.lit(100))
    return frame.where(finite).withColumn("part", part if split is None else F.col("given")).drop("given")


def _prediction(coefficients: Sequence[float], intercept: float) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.col(f"x{i}") * float(c) for i, c in enumerate(coefficients)],
        F.lit(float(intercept)),
    )


def _metrics(y: Column, p: Column, prefix: str) -> list[Column]:
    error = F.abs(y - p)
    return [
        F.count(y).alias(f"{prefix}n"), F.sum((y - p) * (y - p)).alias(f"{prefix}rss"),
        F.var_pop(y).alias(f"{prefix}var"), F.sum(error).alias(f"{prefix}abs"),
        F.sum(y).alias(f"{prefix}sum"),
        F.avg(error / F.greatest(F.abs(y), F.lit(_EPS))).alias(f"{prefix}ape"),
    ]


def _scores(row: Mapping[str, float], prefix: str) -> tuple[float | None, float | None, float | None]:
    n = row[f"{prefix}n"]
    if not n:
        return None, None, None
    tss = row[f"{prefix}var"] * n
    r2 = (1 - row[f"{prefix}rss"] / tss) * 100 if tss else None
    total = row[f"{prefix}sum"]
    wmape = row[f"{prefix}abs"] / total * 100 if total else None
    return r2, wmape, row[f"{prefix}ape"] * 100


def certificate(data: DataFrame, coefficients: Sequence[float], intercept: float, alpha: float) -> tuple[float, float]:
    """How far a fit is from the best one, from a scan of its training rows.

    The first figure is the duality gap: no coefficients reach a penalised error
    that is lower by more.  The second is the largest breach of the optimality
    conditions: residuals correlate with a used term by exactly the penalty, with
    an unused one by no more.
    """
    names = [f"x{i}" for i in range(len(coefficients))]
    rest = data.withColumn("r", F.col("y") - _prediction(coefficients, intercept))
    row = rest.agg(
        *[F.covar_pop(n, "r").alias(f"c_{n}") for n in names],
        F.var_pop("r").alias("rr"), F.covar_pop("y", "r").alias("yr"), F.avg("r").alias("bias"),
    ).first()
    pull, w = np.array([row[f"c_{n}"] for n in names]), np.array(coefficients, dtype=float)
    penalty = alpha * float(np.abs(w).sum())
    # Residuals shrunk until they are feasible for the dual problem.
    largest = float(np.abs(pull).max(initial=0.0))
    scale = min(1.0, alpha / largest) if largest else 1.0
    primal = (row["rr"] + row["bias"] ** 2) / 2 + penalty
    dual = scale * row["yr"] - scale * scale * row["rr"] / 2
    breach = np.where(w != 0, np.abs(pull - alpha * np.sign(w)), np.maximum(0.0, np.abs(pull) - alpha))
    return max(0.0, primal - dual), float(breach.max(initial=0.0))


def _result(df: DataFrame, **values: object) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in MODEL_SCHEMA.replace("map<string,double>", "m").split(",")]
    return local_frame(df.sparkSession, [tuple(values.get(n) for n in names)], MODEL_SCHEMA)


def fit_fixed_alpha(
    df: DataFrame, features: Sequence[str], target: str, parameters: Mapping[str, float] | None = None,
    *, alpha: float = 0.001, split: Column | None = None,
) -> DataFrame:
    """Lasso with a fixed penalty, judged on held-out rows.

    Full-data figures are filled only when the held-out ones reach the
    thresholds.  ``duality_gap`` and ``kkt_residual`` say how near the fit is to
    the best one; see ``certificate``.  Training is one pass of MLlib's normal-equation solver;
    prediction is a column expression, so scoring is one aggregate.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    limits = {"r2_threshold": 90, "wmape": 10, "mape": 10, "relative_tolerance": 0.01,
              **(parameters or {})}
    names = [f for f in features if f in df.columns and f != target]
    if not names or target not in df.columns:
        return _result(df, status="error", message="Features or target column missing.")
    data = model_frame(df, base_terms(names), target, split)
    xs = [f"x{i}" for i in range(len(names))]
    training = VectorAssembler(inputCols=xs, outputCol="features").transform(data.where("part < 70"))
    if training.isEmpty():
        return _result(df, status="error", message="No valid data after cleaning.")
    model = LinearRegression(
        featuresCol="features", labelCol="y", regParam=alpha, elasticNetParam=1.0,
        standardization=False, solver="normal", tol=1e-9,
    ).fit(training)
    coefficients, intercept = [float(c) for c in model.coefficients], float(model.intercept)
    gap, breach = certificate(data.where("part < 70"), coefficients, intercept, alpha)
    y, p = F.col("y"), _prediction(coefficients, intercept)
    held_out = F.when(F.col("part") >= 70, y)
    row = data.agg(
        *_metrics(held_out, p, "t_"), *_metrics(y, p, "a_"), F.stddev_pop(y).alias("sd")
    ).first().asDict()
    r2, wmape, mape = _scores(row, "t_")
    equation = f"{target} = {intercept:.2f}" + "".join(
        f" + ({c:.2f} * {f})" for c, f in zip(coefficients, names) if round(c, 2) != 0
    )
    good = (
        None not in (r2, wmape, mape) and round(r2, 2) >= limits["r2_threshold"]
        and wmape <= limits["wmape"] and mape <= limits["mape"]
    )
    full: dict[str, object] = {}
    if good:
        tolerance = limits["relative_tolerance"] * row["sd"]
        hits = data.agg(F.count_if(F.abs(y - p) <= tolerance)).first()[0]
        r2_all, wmape_all, mape_all = _scores(row, "a_")
        full = {
            "r2_all": round(r2_all, 2), "wmape_all": round(wmape_all, 2),
            "mape_all": round(mape_all, 2), "total_data": row["a_n"],
            "accuracy": round(100.0 * hits / row["a_n"], 2),
        }
    return _result(
        df, features=names, target=target, equation=equation, intercept=intercept,
        coefficients=dict(zip(names, coefficients)), alpha=alpha,
        r2=None if r2 is None else round(r2, 2), wmape=wmape, mape=mape,
        intercept_contribution=intercept * row["t_n"] / row["t_sum"] * 100 if row["t_sum"] else None,
        duality_gap=gap, kkt_residual=breach, status="success", **full,
    )


@dataclass
class Moments:
    """Count, means and scatter of ``(x.., y)``: all a linear fit needs of the data."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def merged(parts: Sequence[Moments]) -> Moments:
        n = sum(p.n for p in parts)
        mean = sum(p.n * p.mean for p in parts) / n
        scatter = sum(p.scatter + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
        return Moments(n, mean, scatter)

    def squared_error(self, weights: np.ndarray, intercept: float) -> float:
        """Mean squared error of a linear model on these rows."""
        v = np.append(-weights, 1.0)
        bias = self.mean @ v - intercept
        return float(v @ self.scatter @ v / self.n + bias * bias)


def fold_moments(data: DataFrame, width: int, folds: int) -> list[Moments]:
    """Moments per fold from one scan of the training rows."""
    names = [*[f"x{i}" for i in range(width)], "y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = (
        data.groupBy(F.pmod("part", F.lit(folds)).alias("fold"))
        .agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"s{i}_{j}") for i, j in pairs],
        ).orderBy("fold").collect()
    )
    moments = []
    for row in rows:
        scatter = np.zeros((len(names), len(names)))
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = row[f"s{i}_{j}"] * row["n"]
        moments.append(Moments(row["n"], np.array([row[f"m{i}"] for i in range(len(names))]), scatter))
    return moments


def _lasso(m: Moments, alpha: float, start: np.ndarray, sweeps: int = 1000) -> np.ndarray:
    """Coordinate descent on the moments, for ``RSS / 2n + alpha * |w|``."""
    gram, xy, y_scale = m.scatter[:-1, :-1] / m.n, m.scatter[:-1, -1] / m.n, m.scatter[-1, -1] / m.n
    w = start.copy()
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rest = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / gram[j, j]
            largest = max(largest, abs(new - w[j]) * np.sqrt(gram[j, j]))
            w[j] = new
        if largest <= 1e-7 * np.sqrt(max(y_scale, _EPS)):
            break
    return w


def fit_cross_validated(
    df: DataFrame, features: Sequence[str], target: str, *, relative_tolerance: float = 0.05,
    folds: int = 5, alphas: int = 100, relation_type: str | None = None, code: str | None = None,
    products_up_to: int = 5, ratios_up_to: int = 4, terms: Mapping[str, Column] | None = None, split: Column | None = None,
) -> DataFrame:
    """Lasso over features, products and ratios, its penalty chosen by cross-validation.

    ``terms`` names the terms and says how each follows from the columns.
    Without it products join up to ``products_up_to`` features and ratios up to
    ``ratios_up_to``; the keys of ``coefficients`` say which terms took part.
    ``duality_gap`` and ``kkt_residual`` are those of the final fit.

    A grid search would train folds x penalties models, each a pass over the
    data.  One pass collects the moments of every fold instead: a few hundred
    numbers that determine every fit and every validation error exactly.
    """
    names = [f for f in features if f in df.columns]
    schema = (
        "source string, relation_type string, target string, code string, equation string, "
        "r2_test double, mape_test double, accuracy double, intercept double, "
        "coefficients map<string,double>, features array<string>, data_points bigint, "
        "alpha double, duality_gap double, kkt_residual double, error string"
    )
    source = "Lasso Regression with Relations"

    def failed(message: str) -> DataFrame:
        row = (source, *[None] * 14, message)
        return local_frame(df.sparkSession, [row], schema)

    if target not in df.columns or not names:
        return failed("Missing target or features")
    model = extended_terms(names, products_up_to, ratios_up_to) if terms is None else Terms(dict(terms), tuple(names))
    data = model_frame(df, model, target, split)
    width = len(model.columns)
    parts = fold_moments(data.where("part < 70"), width, folds)
    training = Moments.merged(parts) if parts else None
    if training is None or training.n < 7 or len(parts) < folds:
        return failed("Insufficient clean data")
    top = float(np.max(np.abs(training.scatter[:-1, -1])) / training.n)
    grid = np.geomspace(max(top, _EPS), max(top, _EPS) * 1e-3, alphas)
    errors = np.zeros(len(grid))
    for i, held_out in enumerate(parts):
        rest = Moments.merged(parts[:i] + parts[i + 1:])
        w = np.zeros(width)
        for k, alpha in enumerate(grid):
            w = _lasso(rest, alpha, w)
            errors[k] += held_out.squared_error(w, rest.mean[-1] - rest.mean[:-1] @ w)
    alpha = float(grid[int(np.argmin(errors))])
    w = np.zeros(width)
    for a in grid[grid >= alpha]:
        w = _lasso(training, a, w)
    intercept = float(training.mean[-1] - training.mean[:-1] @ w)
    gap, breach = certificate(data.where("part < 70"), w, intercept, alpha)
    y, p = F.col("y"), _prediction(w, intercept)
    stats = data.agg(
        *_metrics(F.when(F.col("part") >= 70, y), p, "t_"), F.count(y).alias("n"),
        F.stddev_pop(y).alias("sd"),
    ).first().asDict()
    hits = data.agg(F.count_if(F.abs(y - p) <= relative_tolerance * stats["sd"])).first()[0]
    r2, _, mape = _scores(stats, "t_")
    kept = [f"({c:.4f} * {t})" for c, t in zip(w, model.columns) if abs(c) > 1e-6]
    equation = f"{target} = " + " + ".join([f"{intercept:.4f}", *kept])
    return local_frame(df.sparkSession, [(
        source, relation_type, target, code, equation,
        None if r2 is None else round(r2, 2), None if mape is None else round(mape, 2),
        round(100.0 * hits / stats["n"], 2), round(intercept, 6),
        {t: round(float(c), 6) for t, c in zip(model.columns, w)}, list(names), stats["n"], alpha, gap, breach, None,
    )], schema)
