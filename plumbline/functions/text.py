"""Missing-value and text predicates shared by every check."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation, localcontext

from pyspark.sql import Column, functions as F, types as T


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_blank(col: Column, dtype: T.DataType) -> Column:
    """NULL, or text of nothing but spaces.

    Only text can be blank, so other types skip the cast to string and keep the
    plain null test, which Parquet answers from its definition levels.
    """
    if is_text(dtype):
        return col.isNull() | (F.trim(col.cast("string")) == "")
    return col.isNull()


def is_filled(col: Column, dtype: T.DataType) -> Column:
    if is_text(dtype):
        return col.isNotNull() & (F.trim(col.cast("string")) != "")
    return col.isNotNull()


def full_match(col: Column, pattern: str) -> Column:
    """Whole-string regular expression match; the group keeps alternations together."""
    return col.cast("string").rlike(whole(pattern))


def whole(pattern: str) -> str:
    """The pattern anchored at both ends; ``$`` would also match before a final line break."""
    return rf"\A(?:{pattern})\z"


def number_kind(dtype: T.DataType) -> str:
    """The type in which values of a numeric column are compared without loss."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    return dtype.simpleString() if isinstance(dtype, T.DecimalType) else "double"


def _decimal(value: object) -> Decimal | None:
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


def exact_value(value: object, dtype: T.DataType) -> int | Decimal | float | None:
    """The value as the column would hold it; None where it cannot."""
    if not isinstance(dtype, (T.IntegralType, T.DecimalType)):
        try:
            return float(str(value))
        except ValueError:
            return None
    number = _decimal(value)
    if number is None or number.adjusted() > 60:
        return None
    with localcontext(prec=200):
        if isinstance(dtype, T.IntegralType):
            return int(number) if number == number.to_integral_value() and -(2**63) <= number < 2**63 else None
        step = Decimal(1).scaleb(-dtype.scale)
        fits = number == number.quantize(step) and abs(number) < Decimal(10) ** (dtype.precision - dtype.scale)
        return number.quantize(step) if fits else None


def exact_number(value: object, dtype: T.DataType) -> Column | None:
    """A literal of the column's own kind; None where the column cannot hold the value."""
    own = exact_value(value, dtype)
    return None if own is None else F.lit(own).cast(number_kind(dtype))


def exact_kind(dtype: T.DataType) -> bool:
    """Whether values of the type are whole numbers or decimals, which doubles would blur."""
    return isinstance(dtype, (T.IntegralType, T.DecimalType))


def compared(col: Column, dtype: T.DataType, sign: str, bound: object) -> Column:
    """``col <sign> bound`` for ``<``, ``<=``, ``>`` and ``>=``, without loss; NULL where ``col`` is NULL.

    A bound between two values that the column can hold is moved to the nearer
    one that leaves the answer as it is, so the comparison stays in the column's
    own type.  A bound beyond the type's range decides for every row.
    """
    if not exact_kind(dtype):
        return _ordered(col, sign, F.lit(float(str(bound))))
    number = _decimal(bound)
    if number is None:
        value = float(str(bound))
        if value != value:
            raise ValueError(f"bound is not a number: {bound!r}")
        return F.when(col.isNotNull(), F.lit(sign.startswith("<") == (value > 0)))
    scale = 0 if isinstance(dtype, T.IntegralType) else dtype.scale
    with localcontext(prec=max(200, abs(number.adjusted()) + 80)):
        step = Decimal(1).scaleb(-scale)
        nearest = number.quantize(step, rounding=ROUND_CEILING if sign in ("<", ">=") else ROUND_FLOOR)
        least, most = (
            (Decimal(-(2**63)), Decimal(2**63 - 1)) if isinstance(dtype, T.IntegralType)
            else (step - Decimal(10) ** (dtype.precision - scale), Decimal(10) ** (dtype.precision - scale) - step)
        )
        if not least <= nearest <= most:
            return F.when(col.isNotNull(), F.lit(sign.startswith("<") == (nearest > most)))
    literal = F.lit(int(nearest)).cast("bigint") if scale == 0 and isinstance(dtype, T.IntegralType) else F.lit(nearest).cast(dtype)
    return _ordered(col, sign, literal)


def _ordered(left: Column, sign: str, right: Column) -> Column:
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]


def member_of(col: Column, dtype: T.DataType, values: Sequence[object]) -> Column:
    """``col`` is one of ``values``; NULL when ``col`` is NULL.

    Numeric columns are compared as numbers, so 5 and "5" both match 5.0; all
    other columns are compared by their text.
    """
    if isinstance(dtype, T.NumericType):
        items = [v for v in (exact_value(x, dtype) for x in values if x is not None) if v is not None]
        probe = col.cast(number_kind(dtype))
    else:
        items = [literal_text(v) for v in values if v is not None]
        probe = col.cast("string")
    if not items:
        return F.when(probe.isNotNull(), F.lit(False))
    return probe.isin(list(dict.fromkeys(items)))


def literal_text(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)
