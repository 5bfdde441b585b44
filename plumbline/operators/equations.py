"""Checking equations between columns against the data."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.local import local_frame
from plumbline.model import quoted

RESULT = (
    "equation string, valid boolean, satisfaction_rate double, total_records bigint, "
    "satisfied_records bigint, error_message string"
)


class EquationError(ValueError):
    """An expression with anything but columns, numbers, + - * / and parentheses."""


@dataclass(frozen=True)
class Equation:
    text: str
    target: str
    predicted: Column
    columns: tuple[str, ...]


def parse_equation(text: str, columns: Sequence[str]) -> Equation:
    """``target = expression`` as a column; raises EquationError for anything else."""
    target, _, expression = (part.strip() for part in text.partition("="))
    if target not in columns:
        raise EquationError(f"Target column '{target}' not found")
    # Column names that are no identifiers get one for parsing.
    aliases = {f"_c{i}": c for i, c in enumerate(columns) if not c.isidentifier()}
    for alias, name in sorted(aliases.items(), key=lambda kv: -len(kv[1])):
        expression = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", alias, expression)
    used: list[str] = []
    try:
        tree = ast.parse(expression, mode="eval").body
    except SyntaxError:
        raise EquationError("Expression evaluation error: invalid syntax") from None
    predicted = _column(tree, {**{c: c for c in columns}, **aliases}, used)
    return Equation(text, target, predicted, tuple(dict.fromkeys([target, *used])))


def _column(node: ast.expr, names: dict[str, str], used: list[str]) -> Column:
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if node.id not in names:
            raise EquationError(f"Expression evaluation error: name '{node.id}' is not defined")
        used.append(names[node.id])
        return F.col(quoted(names[node.id])).cast("double")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = _column(node.operand, names, used)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp):
        left, right = _column(node.left, names, used), _column(node.right, names, used)
        if isinstance(node.op, ast.Add):
            return left + right
        if isinstance(node.op, ast.Sub):
            return left - right
        if isinstance(node.op, ast.Mult):
            return left * right
        if isinstance(node.op, ast.Div):
            # Division by zero satisfies no equation; NULL says so.
            return F.try_divide(left, right)
    raise EquationError(f"Expression evaluation error: {type(node).__name__} is not allowed")


def validate_equations(
    df: DataFrame, equations: Sequence[str], tolerance: float, min_rate: float = 90.0
) -> DataFrame:
    """One row per equation: how many complete records satisfy it; one scan for all."""
    total = F.count(F.lit(1))
    aggregates, rows = [total.alias("n")], []

    def row(text: str, valid: Column, rate: Column, records: Column, good: Column, error: Column) -> Column:
        values = (F.lit(text), valid, rate, records, good, error)
        fields = T.StructType.fromDDL(RESULT).fields
        return F.struct(*[v.cast(f.dataType).alias(f.name) for f, v in zip(fields, values)])

    def failure(text: str, message: str, records: Column) -> Column:
        return row(text, F.lit(False), F.lit(0.0), records, F.lit(0), F.lit(message))

    for i, text in enumerate(equations):
        if "=" not in text:
            rows.append(failure(text, "Invalid equation format (no equals sign)", F.lit(0)))
            continue
        try:
            equation = parse_equation(text, df.columns)
        except EquationError as e:
            rows.append(failure(text, str(e), F.col("n")))
            continue
        actual = F.col(quoted(equation.target)).cast("double")
        present = _all_present(df, equation.columns)
        allowed = F.greatest(F.lit(float(tolerance)) * F.abs(actual), F.lit(1e-6))
        holds = F.coalesce(F.abs(actual - equation.predicted) <= allowed, F.lit(False))
        aggregates += [
            F.count_if(present).alias(f"n{i}"), F.count_if(present & holds).alias(f"ok{i}")
        ]
        records, good = F.col(f"n{i}"), F.col(f"ok{i}")
        rate = F.coalesce(F.try_divide(good.cast("double"), records) * 100, F.lit(0.0))
        valid = rate >= min_rate
        message = (
            F.when(records == 0, "No valid records (all NaN)")
            .when(~valid, F.format_string("Only %.2f%% records satisfy the equation", rate))
        )
        rows.append(row(text, valid & (records > 0), F.round(rate, 2),
                        F.when(records == 0, F.col("n")).otherwise(records), good, message))
    if not rows:
        return local_frame(df.sparkSession, [], RESULT)
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _all_present(df: DataFrame, columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for name in columns:
        col = F.col(quoted(name))
        test = test & col.isNotNull()
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            test = test & ~F.isnan(col)
    return test
