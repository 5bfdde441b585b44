"""The catalogue: expectation names and the checks that evaluate them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.local import local_frame
from plumbline.model import Rule, RuleError
from plumbline.operators import aggregate_checks as agg
from plumbline.operators import group_checks as grp
from plumbline.operators import row_checks as row
from plumbline.operators import table_checks as tab
from plumbline.operators.base import Check, Context

Builder = Callable[[Context, Rule], Check]

EXPECTATIONS: dict[str, Builder] = {
    "expect_column_values_to_not_be_null": row.not_null,
    "expect_column_values_to_be_null": row.null_only,
    "expect_column_values_to_be_between": row.between,
    "expect_column_values_to_match_regex": row.match_regex,
    "expect_column_values_to_match_regex_list": row.match_regex_list,
    "expect_column_values_to_not_match_regex": row.not_match_regex,
    "expect_column_values_to_not_match_regex_list": row.not_match_regex_list,
    "expect_column_values_to_be_in_set": row.in_set,
    "expect_column_values_to_not_be_in_set": row.not_in_set,
    "expect_column_value_lengths_to_be_between": row.length_between,
    "expect_column_value_lengths_to_equal": row.length_equal,
    "expect_column_values_to_be_of_type": row.of_type,
    "expect_column_value_z_scores_to_be_less_than": row.z_score_below,
    "expect_column_pair_values_a_to_be_greater_than_b": row.pair_greater,
    "expect_column_pair_values_to_be_equal": row.pair_equal,
    "expect_column_pair_values_to_be_in_set": row.pair_in_set,
    "expect_column_values_to_be_unique": grp.unique,
    "expect_compound_columns_to_be_unique": grp.compound_unique,
    "expect_multicolumn_sum_to_equal": row.multicolumn_sum,
    "expect_select_column_values_to_be_unique_within_record": row.unique_within_record,
    "unexpected_rows_expectation": tab.unexpected_rows,
    "expect_column_min_to_be_between": agg.minimum,
    "expect_column_max_to_be_between": agg.maximum,
    "expect_column_sum_to_be_between": agg.total,
    "expect_column_mean_to_be_between": agg.mean,
    "expect_column_median_to_be_between": agg.median,
    "expect_column_stdev_to_be_between": agg.deviation,
    "expect_column_proportion_of_non_null_values_to_be_between": agg.share_non_null,
    "expect_column_proportion_of_unique_values_to_be_between": grp.share_unique,
    "expect_column_unique_value_count_to_be_between": grp.distinct_count,
    "expect_column_most_common_value_to_be_in_set": grp.most_common_in_set,
    "expect_column_values_to_be_fresh": agg.freshness,
    "expect_column_distinct_values_to_contain_set": grp.distinct_contains_set,
    "expect_column_distinct_values_to_equal_set": grp.distinct_equals_set,
    "expect_column_distinct_values_to_be_in_set": grp.distinct_in_set,
    "expect_table_row_count_to_be_between": agg.row_count_between,
    "expect_table_row_count_to_equal": agg.row_count_equal,
    "expect_table_row_count_to_equal_other_table": agg.row_count_equals_other,
    "expect_table_column_count_to_be_between": tab.column_count_between,
    "expect_table_column_count_to_equal": tab.column_count_equal,
    "expect_column_to_exist": tab.column_exists,
    "expect_table_columns_to_match_ordered_list": tab.columns_match_list,
    "expect_table_columns_to_match_set": tab.columns_match_set,
}

# Second names under which a check is also known.
ALIASES = {
    "expect_column_values_to_be_in_reference_set": "expect_column_values_to_be_in_set",
}


def build_check(ctx: Context, rule: Rule) -> Check:
    name = rule.expectation.lower()
    builder = EXPECTATIONS.get(ALIASES.get(name, name))
    if builder is None:
        raise RuleError(f"unknown expectation {rule.expectation!r}")
    return builder(ctx, rule)


def catalogue(spark: SparkSession) -> DataFrame:
    """Every expectation name with the kind of check behind it."""
    kinds = {row: "ROW", grp: "GROUP", agg: "AGGREGATE", tab: "TABLE"}
    by_module = {m.__name__: kind for m, kind in kinds.items()}
    names = {**{n: n for n in EXPECTATIONS}, **ALIASES}
    return local_frame(
        spark, [(n, t, by_module[EXPECTATIONS[t].__module__]) for n, t in names.items()],
        "expectation_name string, canonical_name string, kind string",
    )
