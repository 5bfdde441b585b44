"""Data quality checks, profiling and relationship mining on Spark DataFrames."""

from plumbline.model import Dataset, Rule, RuleError, Status
from plumbline.plans.suite import evaluate, run_suite

__all__ = ["Dataset", "Rule", "RuleError", "Status", "evaluate", "run_suite"]
