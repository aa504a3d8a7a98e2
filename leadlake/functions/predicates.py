"""Lead predicates as Columns. All are plain true/false, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions.common import all_of, any_of, filled
from leadlake.functions.contact import first_number


def is_qualified() -> Column:
    return F.col("email").isNotNull() | F.col("phone").isNotNull()


def all_set(*names: str) -> Column:
    return all_of(F.col(n).isNotNull() for n in names)


def is_high_quality() -> Column:
    high_score = F.coalesce(F.col("score") > 70, F.lit(False))
    return high_score | all_set("email", "phone", "industry", "location")


def is_blank_lead() -> Column:
    return all_of(F.col(n).isNull() for n in ("company", "email", "phone"))


def is_hard_to_find() -> Column:
    return any_of(F.col(n).isNull() for n in ("industry", "location", "description"))


def is_contacted() -> Column:
    return F.col("last_contact").isNotNull()


def should_skip(
    fields: dict[str, Column],
    required: list[str] | None = None,
    min_employees: int | None = None,
    max_employees: int | None = None,
) -> Column:
    """True when a required field is empty or the head count is out of range; unreadable counts pass."""
    tests = [~filled(fields[name]) for name in required or []]
    count = first_number(fields["employees"]) if "employees" in fields else F.lit(None).cast("long")
    if min_employees:
        tests.append(F.coalesce(count < min_employees, F.lit(False)))
    if max_employees:
        tests.append(F.coalesce(count > max_employees, F.lit(False)))
    return any_of(tests) if tests else F.lit(False)
