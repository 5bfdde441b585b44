"""Microsegment profiles: numbered records, dataset summary, attribute statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.durable import kept
from plumbline.functions.local import local_frame
from plumbline.functions.rows import numbered
from plumbline.functions.text import is_text, number_kind
from plumbline.model import quoted
from plumbline.operators.percentiles import column_percentiles
from plumbline.operators.profile import TYPE_BYTES, ProfileOptions, column_values, key_counts, profile_columns, type_counts

# Unicode general categories and their names.
CATEGORIES = {
    "Lu": "Uppercase Letter", "Ll": "Lowercase Letter", "Lt": "Titlecase Letter",
    "Lm": "Modifier Letter", "Lo": "Other Letter", "Mn": "Nonspacing Mark",
    "Mc": "Spacing Mark", "Me": "Enclosing Mark", "Nd": "Decimal Number",
    "Nl": "Letter Number", "No": "Other Number", "Pc": "Connector Punctuation",
    "Pd": "Dash Punctuation", "Ps": "Open Punctuation", "Pe": "Close Punctuation",
    "Pi": "Initial Punctuation", "Pf": "Final Punctuation", "Po": "Other Punctuation",
    "Sm": "Math Symbol", "Sc": "Currency Symbol", "Sk": "Modifier Symbol",
    "So": "Other Symbol", "Zs": "Space Separator", "Zl": "Line Separator",
    "Zp": "Paragraph Separator", "Cc": "Control", "Cf": "Format",
}
# Scripts told apart; everything else counts as Common.
SCRIPTS = (
    "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali",
    "Tamil", "Thai", "Georgian", "Hangul", "Hiragana", "Katakana", "Han",
)
# Unicode blocks told apart, by first and last code point.
BLOCKS = {
    "Basic Latin": (0x0000, 0x007F), "Latin-1 Supplement": (0x0080, 0x00FF),
    "Latin Extended-A": (0x0100, 0x017F), "Latin Extended-B": (0x0180, 0x024F),
    "Greek and Coptic": (0x0370, 0x03FF), "Cyrillic": (0x0400, 0x04FF),
    "Hebrew": (0x0590, 0x05FF), "Arabic": (0x0600, 0x06FF),
    "Devanagari": (0x0900, 0x097F), "Thai": (0x0E00, 0x0E7F),
    "General Punctuation": (0x2000, 0x206F), "Currency Symbols": (0x20A0, 0x20CF),
    "CJK Symbols and Punctuation": (0x3000, 0x303F), "Hiragana": (0x3040, 0x309F),
    "Katakana": (0x30A0, 0x30FF), "CJK Unified Ideographs": (0x4E00, 0x9FFF),
    "Hangul Syllables": (0xAC00, 0xD7AF), "Halfwidth and Fullwidth Forms": (0xFF00, 0xFFEF),
}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HISTOGRAM_BINS = 50


def microsegment_records(
    df: DataFrame, *, order_by: Sequence[str] = (), sample: int | None = None,
    dataset_id: int = 0, microsegment_def_id: int = 0, kpi_id: int = 0, snapshot_id: int = 0,
) -> DataFrame:
    """Every row of a microsegment query as a numbered JSON document.

    ``sample`` keeps a number of rows, chosen by a hash of their content so that
    a rerun chooses the same ones; by default all rows are kept.
    """
    source = df
    if sample is not None:
        key = F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
        source = df.orderBy(key, *[F.col(quoted(c)) for c in df.columns]).limit(sample)
    rows = numbered(source, order_by, "microsegment_id")
    return rows.select(
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        F.lit(kpi_id).cast("bigint").alias("kpi_id"),
        F.lit(microsegment_def_id).cast("bigint").alias("microsegment_def_id"),
        F.lit(snapshot_id).cast("bigint").alias("microsegment_profiler_snapshot_id"),
        "microsegment_id",
        F.to_json(
            F.struct(*[F.col(quoted(c)) for c in df.columns]), {"ignoreNullFields": "false"}
        ).alias("microsegment_profile"),
    )


def microsegment_summary(df: DataFrame) -> DataFrame:
    """One row: records, columns, bytes, missing cells and columns, types, duplicates."""
    names = df.columns
    columns = [F.col(quoted(c)) for c in names]
    # Texts by their bytes in UTF-8, other values by the width of their type.
    sizes = [
        F.sum(F.octet_length(quoted(f.name))) if is_text(f.dataType)
        else F.count(F.col(quoted(f.name))) * TYPE_BYTES.get(type(f.dataType), 8) for f in df.schema.fields
    ]
    memory = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in sizes])
    missing = {c: F.count_if(F.col(quoted(c)).isNull()) for c in names}
    # Equal rows are counted before the shuffle; the rest are sums over groups.
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    duplicates = groups.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, 1)), F.lit(0))
    ).scalar()
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), memory.cast("bigint").alias("memory"), *[m.alias(f"m{i}") for i, m in enumerate(missing.values())]
    )
    per_column = [F.col(f"m{i}") for i in range(len(names))]
    cells = F.col("n") * len(names)
    total_missing = reduce(lambda a, b: a + b, per_column)
    with_missing = reduce(lambda a, b: a + b, [F.when(m > 0, 1).otherwise(0) for m in per_column])
    all_missing = reduce(
        lambda a, b: a + b,
        [F.when((m == F.col("n")) & (m > 0), 1).otherwise(0) for m in per_column],
    )
    return counted.select(
        F.col("n").alias("total_records"),
        F.lit(len(names)).alias("total_columns"),
        F.col("memory").alias("memory_size_bytes"),
        F.coalesce(F.try_divide(F.col("memory").cast("double"), F.col("n")), F.lit(0.0)).alias("average_record_size_bytes"),
        total_missing.alias("missing_values_count"),
        with_missing.alias("columns_with_missing_values"),
        all_missing.alias("columns_fully_missing"),
        F.coalesce(F.try_divide(total_missing.cast("double"), cells), F.lit(0.0)).alias("missing_values_share"),
        F.lit(type_counts(df)).alias("column_data_types"),
        duplicates.alias("duplicate_records_count"),
        F.coalesce(F.try_divide(duplicates.cast("double"), F.col("n")), F.lit(0.0)).alias("duplicate_records_share"),
    )


def _numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def histograms(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(column_name, bin, bin_start, bin_end, n)``: equal-width bins, the last one closed."""
    names = _numeric_names(df)
    limits = df.agg(F.struct(*[
        F.struct(F.min(F.col(quoted(c)).cast("double")).alias("low"),
                 F.max(F.col(quoted(c)).cast("double")).alias("high")).alias(f"c{i}")
        for i, c in enumerate(names)
    ])).scalar()
    limit = F.col("_limits")
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).cast("double").alias("v"),
                 limit[f"c{i}"]["low"].alias("low"), limit[f"c{i}"]["high"].alias("high"))
        for i, c in enumerate(names)
    ])
    rows = df.withColumn("_limits", limits).select(F.inline(entries)).where(F.col("v").isNotNull())
    width = (F.col("high") - F.col("low")) / bins
    index = F.least(
        F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("low"), width)), F.lit(0))
    )
    counted = rows.groupBy("column_name", index.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    return counted.select(
        "column_name", "bin", (F.col("low") + width * F.col("bin")).alias("bin_start"),
        (F.col("low") + width * (F.col("bin") + 1)).alias("bin_end"), "n",
    )


def numeric_statistics(df: DataFrame) -> DataFrame:
    """Per numeric column: variance, range, IQR, CV, deviation from the median, infinities."""
    names = _numeric_names(df)
    profile = profile_columns(df.select(*[quoted(c) for c in names]),
                              ProfileOptions(exact=True, extended=True))
    # One number per column.
    medians = {r["column_name"]: r["p50"] for r in profile.select("column_name", "p50").collect() if r["p50"] is not None}

    def apart(name: str) -> Column:
        return F.abs(F.col(quoted(name)).cast("double") - F.lit(medians.get(name)).cast("double"))

    deviations = [
        F.struct(F.lit(c).alias("column_name"), apart(c).alias("d"), F.col(quoted(c)).cast("double").alias("v")) for c in names
    ]
    spread = (
        df.select(F.inline(F.array(*deviations))).where(F.col("d").isNotNull())
        .groupBy("column_name").agg(
            F.avg("d").alias("mean_absolute_deviation"),
            F.count_if(F.abs("v") == float("inf")).alias("infinite_count"),
        )
    )
    # Exact, as the medians are; one row per column.
    middle = column_percentiles(df, {c: apart(c) for c in names}, [0.5]).select(
        "column_name", F.col("value").alias("median_absolute_deviation")
    )
    spread = spread.join(F.broadcast(middle), "column_name", "left")
    return profile.join(F.broadcast(spread), "column_name", "left").select(
        "column_name", "mean_value", "std_dev",
        (F.col("std_dev") * F.col("std_dev")).alias("variance_value"),
        (F.col("max_value").try_cast("double") - F.col("min_value").try_cast("double")).alias("value_range"),
        (F.col("p75") - F.col("p25")).alias("interquartile_range"),
        F.try_divide("std_dev", "mean_value").alias("coefficient_of_variation"),
        "median_absolute_deviation", "mean_absolute_deviation",
        "kurtosis_value", "skewness_value", "negative_count", "zero_count", "infinite_count",
    )


def frequency_statistics(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per column, how evenly values occur: chi-squared against uniform, imbalance."""
    if counts is None:
        counts = key_counts(df, df.columns)
    n = F.col("n").cast("double")
    total, kinds = F.sum(n), F.count(F.lit(1))
    expected = total / kinds
    chi = F.sum(n * n) / expected - total
    entropy = F.log2(total) - F.sum(n * F.log2(n)) / total
    return counts.groupBy("column_name").agg(
        kinds.alias("distinct_count"),
        F.count_if(F.col("n") == 1).alias("unique_count"),
        chi.alias("chi_squared"),
        F.when(kinds > 1, 1 - entropy / F.log2(kinds.cast("double"))).alias("data_imbalance"),
    )


def character_counts(counts: DataFrame) -> DataFrame:
    """``(column_name, character, n)`` over whole texts ``(column_name, value, n)``.

    Texts straight from the rows, as ``column_values`` gives them, are added up
    in their tasks; none is shuffled.
    """
    chars = counts.select(
        "column_name", "n", F.explode(F.split("value", "")).alias("character")
    ).where(F.col("character") != "")
    return chars.groupBy("column_name", "character").agg(F.sum("n").alias("n"))


def word_counts(counts: DataFrame) -> DataFrame:
    """``(column_name, word, n)``: lower-cased words without surrounding punctuation, counted in their tasks first."""
    words = counts.select(
        "column_name", "n", F.explode(F.split(F.lower("value"), r"\s+")).alias("word")
    ).select("column_name", "n", F.btrim("word", F.lit(PUNCTUATION)).alias("word"))
    return words.where(F.col("word") != "").groupBy("column_name", "word").agg(F.sum("n").alias("n"))


def length_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column_name", F.length("value").alias("length")).agg(F.sum("n").alias("n"))


def character_category(char: Column) -> Column:
    found = F.lit(None).cast("string")
    for code, name in reversed(CATEGORIES.items()):
        found = F.when(char.rlike(rf"^\p{{{code}}}$"), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit("Unassigned"))


def character_script(char: Column) -> Column:
    found = F.lit("Common")
    for script in reversed(SCRIPTS):
        found = F.when(char.rlike(rf"^\p{{Is{script}}}$"), F.lit(script)).otherwise(found)
    return found


def character_block(char: Column) -> Column:
    point = F.ascii(char)
    found = F.lit("Other")
    for name, (first, last) in reversed(BLOCKS.items()):
        found = F.when((point >= first) & (point <= last), F.lit(name)).otherwise(found)
    return found


def character_classes(chars: DataFrame) -> DataFrame:
    """``(column_name, kind, class, characters, n)`` by category, script and block.

    Classified after counting, so each distinct character is looked at once.
    """
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), of(F.col("character")).alias("class"))
        for kind, of in (("category", character_category), ("script", character_script),
                         ("block", character_block))
    ])
    return (
        chars.select("column_name", "n", F.inline(kinds))
        .groupBy("column_name", "kind", "class")
        .agg(F.count(F.lit(1)).alias("characters"), F.sum("n").alias("n"))
    )


#: Steps of an order in one slice, about.
SLICE_STEPS = 1 << 20


def monotonicity(df: DataFrame, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column, is it increasing or decreasing along ``order_by``?

    Rows with equal order are one step whose values may come in any order.  The
    steps are dealt by ranges of the order, as many as they fill; a window
    compares neighbours inside a range, and one row per range is left to compare
    the ranges with each other.  Order and values are compared in their own
    kind, so longs and decimals beyond the digits of doubles are told apart.
    """
    names = [c for c in (columns or _numeric_names(df)) if c != order_by]
    kinds: dict[str, list[str]] = {}
    for c in names:
        kinds.setdefault(number_kind(df.schema[c].dataType), []).append(c)
    if not kinds:
        return _trends(local_frame(df.sparkSession, [], "column_name string, up boolean, strict_up boolean, down boolean, strict_down boolean"))
    return _trends(reduce(DataFrame.unionByName, [_ordered_columns(df, order_by, kind, own) for kind, own in kinds.items()]))


def _trends(flags: DataFrame) -> DataFrame:
    return flags.select(
        "column_name",
        F.col("up").alias("monotonic_increasing"),
        F.col("strict_up").alias("strictly_monotonic_increasing"),
        F.col("down").alias("monotonic_decreasing"),
        F.col("strict_down").alias("strictly_monotonic_decreasing"),
        F.when(F.col("strict_up"), 2).when(F.col("up"), 1)
        .when(F.col("strict_down"), -2).when(F.col("down"), -1).otherwise(0).alias("monotonic_trend"),
    )


def _ordered_columns(df: DataFrame, order_by: str, kind: str, names: Sequence[str]) -> DataFrame:
    """``(column_name, up, strict_up, down, strict_down)`` of columns of one kind."""
    values = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).cast(kind).alias("v")) for c in names
    ])
    steps = kept(
        df.select(F.col(quoted(order_by)).alias("o"), F.inline(values))
        .where(F.col("v").isNotNull() & F.col("o").isNotNull())
        .groupBy("column_name", "o")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    )
    slices = max(1, math.ceil(steps.count() / SLICE_STEPS))
    sliced = steps.repartitionByRange(slices, "column_name", "o").withColumn("slice", F.spark_partition_id())
    inside = Window.partitionBy("column_name", "slice").orderBy("o")
    pairs = sliced.withColumns({
        "prev_low": F.lag("low").over(inside), "prev_high": F.lag("high").over(inside),
    })
    ends = pairs.groupBy("column_name", "slice").agg(
        _ordered_flags(F.col("prev_low"), F.col("prev_high"), F.col("low"), F.col("high"), F.col("n")),
        F.min_by(F.struct("low", "high"), "o").alias("first"),
        F.max_by(F.struct("low", "high"), "o").alias("last"),
    )
    across = Window.partitionBy("column_name").orderBy("slice")
    linked = ends.withColumn("before", F.lag("last").over(across))
    jump = {
        "up": F.col("before.high") <= F.col("first.low"),
        "strict_up": F.col("before.high") < F.col("first.low"),
        "down": F.col("before.low") >= F.col("first.high"),
        "strict_down": F.col("before.low") > F.col("first.high"),
    }
    return linked.groupBy("column_name").agg(*[
        F.bool_and(F.col("flags")[f] & F.coalesce(test, F.lit(True))).alias(f) for f, test in jump.items()
    ])


def _ordered_flags(prev_low: Column, prev_high: Column, low: Column, high: Column, n: Column) -> Column:
    def every(test: Column) -> Column:
        return F.bool_and(F.coalesce(test, F.lit(True)))

    single = n == 1
    return F.struct(
        every(prev_high <= low).alias("up"),
        (every(prev_high < low) & F.bool_and(single)).alias("strict_up"),
        every(prev_low >= high).alias("down"),
        (every(prev_low > high) & F.bool_and(single)).alias("strict_down"),
    ).alias("flags")


def attribute_summary(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per column with every statistic that is a number or a short map."""
    profile = profile_columns(df, ProfileOptions(exact=True, extended=True))
    counts = key_counts(df, df.columns)
    texts = _text_names(df)
    chars = character_counts(column_values(df, texts or df.columns[:1]).where(F.lit(bool(texts))))
    classes = character_classes(chars).groupBy("column_name").agg(*[
        stat for kind in ("category", "script", "block") for stat in (
            F.count_if(F.col("kind") == kind).alias(f"{kind}_count"),
            # One entry per class, a few dozen at most.
            F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
                F.when(F.col("kind") == kind, F.struct("class", "n"))
            )))).alias(f"{kind}_frequencies"),
        )
    ])
    char_totals = chars.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_character_count"),
        F.sum("n").alias("total_character_count"),
    )
    parts = [frequency_statistics(df, counts).drop("distinct_count", "unique_count"),
             char_totals, classes]
    if _numeric_names(df):
        parts.append(numeric_statistics(df).select(
            "column_name", "variance_value", "value_range", "interquartile_range",
            "coefficient_of_variation", "median_absolute_deviation", "infinite_count",
        ))
        parts.append(histograms(df).groupBy("column_name").agg(
            F.to_json(F.map_from_entries(F.transform(
                F.array_sort(F.collect_list(F.struct("bin", "n"))),
                lambda e: F.struct(e["bin"].cast("string"), e["n"]),
            ))).alias("value_histogram")
        ))
    if order_by:
        parts.append(monotonicity(df, order_by))
    return reduce(
        lambda a, b: a.join(F.broadcast(b), "column_name", "left"), parts, profile
    )
