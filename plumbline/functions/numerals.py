"""Japanese numerals to numbers and back, as plain column expressions.

Both directions are built from JVM-side functions (``translate``, ``aggregate``,
``regexp_extract_all``), so a numeral column needs no Python worker and a check on one
can share the scan of all other checks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# Numeral characters and what they stand for.
DIGITS = {
    "零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4,
    "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
}
UNITS = {"十": 10, "百": 100, "千": 1000}
BIG_UNITS = {"万": 10_000, "億": 100_000_000, "兆": 1_000_000_000_000}
MINUS = "−"
POINT = "点"
POINT_ALIAS = "・"
NUMERAL_COLUMN_PATTERN = r"^[一二三四五六七八九十百千万億兆0-9.,\s・点〇零]*$"

_WHITESPACE = " \t\n\r\x0b\x0c\xa0　"
_PLAIN_NUMBER = (
    r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*)?\.?(?:\d+(?:_\d+)*)?(?:e[+-]?\d+)?|nan|inf|infinity)$"
)
_WIDE_DIGITS = ("０１２３４５６７８９", "0123456789")


def _lookup(mapping: dict[str, int], char: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, float(v))])
    return F.try_element_at(table, char)


def plain_number(text: Column) -> Column:
    """Text to double; NULL for anything but a number (no type suffixes)."""
    narrow = F.translate(F.btrim(text, F.lit(_WHITESPACE)), *_WIDE_DIGITS)
    cleaned = F.regexp_replace(narrow, r"(?<=\d)_(?=\d)", "")
    return F.when(narrow.rlike(_PLAIN_NUMBER), cleaned.try_cast("double"))


def _pieces(text: Column, body: str, end: str, value) -> Column:
    """Sum of ``value(body, end)`` over the text cut behind each character of ``end``."""
    pattern = F.lit(f"([{body}]*)([{end}]?)")
    values = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), value)
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _below_big(group: Column) -> Column:
    """Thousands, hundreds, tens and ones: each unit counts its digit times, once without a digit."""

    def place(digits: Column, unit: Column) -> Column:
        digit = F.coalesce(_lookup(DIGITS, F.right(digits, F.lit(1))), F.lit(0.0))
        return F.coalesce(_lookup(UNITS, unit) * F.when(digit > 0, digit).otherwise(1.0), digit)

    return _pieces(group, "".join(DIGITS), "".join(UNITS), place)


def _whole_part(text: Column) -> Column:
    """Groups of four places, each times the big unit behind it; NULL where another character occurs."""
    small, big = "".join([*DIGITS, *UNITS]), "".join(BIG_UNITS)
    value = _pieces(text, small, big, lambda group, unit: _below_big(group) * F.coalesce(_lookup(BIG_UNITS, unit), F.lit(1.0)))
    return F.when(text.rlike(f"^[{small}{big}]*$"), value)


def numeral_value(text: Column) -> Column:
    """Number written in digits or Japanese numerals; NULL when it is neither."""
    stripped = F.btrim(text, F.lit(_WHITESPACE))
    negative = stripped.startswith(MINUS) | stripped.startswith("-")
    unsigned = F.when(negative, F.substring(stripped, 2, 1 << 30)).otherwise(stripped)
    unified = F.translate(unsigned, POINT_ALIAS, POINT)
    whole = F.substring_index(unified, POINT, 1)
    has_point = F.instr(unified, POINT) > 0
    decimals = F.when(
        has_point, F.substring(unified, F.instr(unified, POINT) + F.lit(1), F.lit(1 << 30))
    ).otherwise(F.lit(""))
    digits = F.translate(
        decimals, "".join(DIGITS), "".join(str(v) for v in DIGITS.values())
    )
    fraction = (
        F.when(decimals == "", F.lit(0.0))
        .when(decimals.rlike(f"^[{''.join(DIGITS)}]+$"),
              F.concat(F.lit("0."), digits).try_cast("double"))
    )
    magnitude = _whole_part(whole) + fraction
    parsed = F.when(negative, -magnitude).otherwise(magnitude)
    return (
        F.when(text.isNull() | (stripped == ""), F.lit(None).cast("double"))
        .otherwise(F.coalesce(plain_number(text), parsed))
    )


def numeral_text(number: Column) -> Column:
    """Number to Japanese numerals, up to ten decimals; NULL from 10**16 on."""
    value = number.cast("double")
    size = F.abs(value)
    padded = F.lpad(F.floor(size).cast("string"), 16, "0")

    def spoken(i: Column) -> Column:
        digit = F.substring(padded, i + 1, F.lit(1))
        place = F.pmod(F.lit(15) - i, F.lit(4))
        # A leading one is silent before a unit, never in the last place.
        silent = (digit == "0") | ((digit == "1") & (place > 0))
        group = F.substring(padded, i - 2, F.lit(4))
        ends_group = (place == 0) & (group != "0000")
        return F.concat(
            F.when(silent, "").otherwise(F.translate(digit, "123456789", "一二三四五六七八九")),
            F.when(digit == "0", "").otherwise(
                F.element_at(F.array(*[F.lit(u) for u in ("", *UNITS)]), place + 1)
            ),
            F.when(ends_group, F.element_at(
                F.array(*[F.lit(u) for u in ("", *BIG_UNITS)]), ((F.lit(15) - i) / 4 + 1).cast("int")
            )).otherwise(""),
        )

    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), spoken), "")
    rest = (size - F.floor(size).cast("double")).cast("decimal(38,20)").cast("string")
    decimals = F.substring(F.rtrim(F.substring(rest, 3, 20), F.lit("0")), 1, 10)
    tail = F.when(
        decimals != "",
        F.concat(F.lit(POINT), F.translate(decimals, "0123456789", "零一二三四五六七八九")),
    ).otherwise("")
    sign = F.when(value < 0, MINUS).otherwise("")
    return F.when(value == 0, "零").when(size < F.lit(1e16), F.concat(sign, whole, tail))


def normalise_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Replace text columns by their numeric value.

    ``unparsed_columns`` lists, per row, the columns that held text which is not
    a number, so nothing is lost silently.
    """
    columns = list(columns)
    values = {c: numeral_value(F.col(f"`{c}`").cast("string")) for c in columns}
    bad = [
        F.when(
            F.col(f"`{c}`").isNotNull()
            & (F.btrim(F.col(f"`{c}`").cast("string"), F.lit(_WHITESPACE)) != "")
            & v.isNull(),
            F.lit(c),
        )
        for c, v in values.items()
    ]
    unparsed = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.withColumns({"unparsed_columns": unparsed, **values})


def localise_stats(df: DataFrame, columns: Iterable[str], suffix: str = "_ja") -> DataFrame:
    """Add a numeral rendering next to each numeric column of a statistics frame."""
    return df.withColumns({f"{c}{suffix}": numeral_text(F.col(f"`{c}`")) for c in columns})
