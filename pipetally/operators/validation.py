"""Row rules as columns: each bad row carries all of its messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipetally.functions.texts import EMAIL, UUID
from pipetally.sources.crosswalk import APPLICATION_STATUS, INTERVIEW_TYPE, PRIORITY

Rule = tuple[Column, str]


def required(column: str, message: str) -> Rule:
    return F.coalesce(F.col(column), F.lit("")) == "", message


def one_of(column: str, values: Sequence[str], optional: bool = False) -> Rule:
    bad = ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    return (bad & F.col(column).isNotNull() if optional else bad), f"{column}: must be one of {', '.join(values)}"


def positive(column: str, message: str, optional: bool = False) -> Rule:
    bad = F.col(column) <= 0
    return F.coalesce(bad, F.lit(not optional)), message


def matches(column: str, pattern: str, message: str, required_: bool = False) -> Rule:
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    return (empty | ~F.col(column).rlike(pattern)) if required_ else (~empty & ~F.col(column).rlike(pattern)), message


# The rules of the writable tables, with their messages as fixed values.


def application_rules() -> list[Rule]:
    return [
        required("company_name", "Company name is required"), required("position_title", "Position title is required"),
        required("application_date", "Application date is required"), one_of("status", APPLICATION_STATUS),
    ]


def contact_rules() -> list[Rule]:
    return [required("name", "Name is required"), matches("email", EMAIL, "Invalid email"), matches("application_id", UUID, "Invalid application ID")]


def round_rules() -> list[Rule]:
    """A round needs its application, as the table does."""
    return [
        matches("application_id", UUID, "Invalid application ID", required_=True), positive("round_number", "Round number must be positive"), one_of("interview_type", INTERVIEW_TYPE),
        positive("duration_minutes", "Duration must be positive", optional=True), one_of("result", ["Passed", "Failed", "Pending", "Cancelled"], optional=True),
    ]


def task_rules() -> list[Rule]:
    return [
        required("title", "Title is required"), one_of("priority", PRIORITY), one_of("status", ["Pending", "In Progress", "Completed", "Cancelled"]),
        matches("application_id", UUID, "Invalid application ID"),
    ]


def profile_rules() -> list[Rule]:
    """What may be written to a profile: every field may be left out, goals may be cleared."""
    least = lambda c: (F.coalesce(F.col(c) < 0, F.lit(False)), f"{c}: must be 0 or more")
    return [(F.coalesce(F.col("full_name") == "", F.lit(False)), "Full name is required"), least("monthly_application_goal"), least("daily_application_goal")]


def partial(rules: Sequence[tuple[str, Rule]], given: str = "given") -> list[Rule]:
    """The rules of a partial update: each (column, rule) holds only where its column is in the array ``given``."""
    return [(bad & F.array_contains(given, column), message) for column, (bad, message) in rules]


def task_rules_by_column() -> list[tuple[str, Rule]]:
    return list(zip(("title", "priority", "status", "application_id"), task_rules()))


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``errors``, the messages of the rules that a row breaks, in order."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules])))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows without ``errors``, bad rows with them)."""
    checked = validate(df, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
