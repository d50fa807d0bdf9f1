"""Named error scenarios: which errors, which rules, which step budget.

A scenario turns any clean table with its columns into a dirty one; the same seed
gives the same errors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import inject as I, rules as R
from ..operators.rules import Rule

# Category variants and allowed categories.
GENDER_VARIANTS = {"Male": ["M", "male", "MALE", "m"], "Female": ["F", "female", "FEMALE", "f"]}
REGIONS = ["North", "South", "East", "West", "Central"]
BLOOD_TYPES = ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"]


@dataclass(frozen=True)
class Scenario:
    """Errors to inject, rules to check, golden rows and the step budget."""

    description: str
    key: str
    injections: tuple[I.Injection, ...]
    rules: tuple[Rule, ...]
    budget: int
    golden_rows: int
    duplicate_rate: float
    near_duplicate_name: str | None = None
    near_duplicate_rate: float = 0.0


@dataclass(frozen=True)
class Prepared:
    """A scenario applied to a clean table."""

    dirty: DataFrame
    truth: DataFrame
    issues: DataFrame
    golden: DataFrame
    scenario: Scenario


# Fixed values below: rates, ranges, rules and budgets of the three scenarios.
SCENARIOS = {
    "customer_records": Scenario(
        "customer records: missing values, duplicates, city typos",
        key="customer_id",
        injections=(
            I.nulls("age", 0.10),
            I.nulls("email", 0.10),
            I.respell("city", 0.06, [F.lower, I.without_second_letter, I.without_spaces]),
        ),
        rules=(
            R.value_range("age", 0, 120, "age between 0 and 120"),
            R.not_null("email", "email is required"),
            R.pattern("email", r".*@.*\..*", "email holds @ and a domain"),
        ),
        budget=30, golden_rows=5, duplicate_rate=0.10,
    ),
    "sales_transactions": Scenario(
        "sales: types, dates, missing values, duplicates, outliers",
        key="transaction_id",
        injections=(
            I.nulls("price", 0.05),
            I.nulls("category", 0.05),
            I.nulls("region", 0.05),
            I.currency_text("price", 0.05),
            I.date_formats("date", 0.075, ["dd/MM/yyyy"]),
            I.sign_flip("quantity", 0.025),
            I.outliers("price", 0.015, 50000, 99999),
        ),
        rules=(
            R.value_range("price", 0, 10000, "price between 0 and 10000"),
            R.value_range("quantity", 1, 1000, "quantity between 1 and 1000"),
            R.not_null("transaction_id", "transaction id is required"),
            R.categorical("region", REGIONS, "region is one of five"),
        ),
        budget=50, golden_rows=8, duplicate_rate=0.08,
    ),
    "health_records": Scenario(
        "health records: near duplicates, logic errors, impossible values, formats",
        key="patient_id",
        injections=(
            *[
                I.nulls(c, 0.02)
                for c in ("name", "blood_type", "height_cm", "weight_kg", "diagnosis", "medication")
            ],
            I.variants("gender", 0.04, GENDER_VARIANTS, kind="category_variant"),
            I.respell("blood_type", 0.015, [F.lower, I.spelled_sign]),
            I.sign_flip("height_cm", 0.005),
            I.outliers("height_cm", 0.003, 300, 500, digits=1),
            I.outliers("weight_kg", 0.003, -100, -10, digits=1),
            I.logic_error("bp_diastolic", "bp_systolic", 0.01, 10, 40),
            I.date_formats("visit_date", 0.03, ["dd/MM/yyyy", "MM-dd-yyyy", "dd MMM yyyy"]),
            I.date_formats("dob", 0.02, ["dd/MM/yyyy", "MM-dd-yyyy"]),
        ),
        rules=(
            R.value_range("height_cm", 30, 250, "height between 30 and 250 cm"),
            R.value_range("weight_kg", 1, 300, "weight between 1 and 300 kg"),
            R.cross_column("bp_systolic", "bp_diastolic", "greater_than", "systolic above diastolic"),
            R.categorical("gender", ["Male", "Female"], "gender is one of two"),
            R.categorical("blood_type", BLOOD_TYPES, "blood type is one of eight"),
            R.not_null("patient_id", "patient id is required"),
        ),
        budget=80, golden_rows=15, duplicate_rate=0.05,
        near_duplicate_name="name", near_duplicate_rate=0.02,
    ),
}


def prepare(clean: DataFrame, scenario: Scenario | str, seed: int = 42) -> Prepared:
    """The clean table with the errors of a scenario, and everything needed to score it."""
    if isinstance(scenario, str):
        if scenario not in SCENARIOS:
            raise ValueError(f"unknown scenario {scenario!r}; use one of {list(SCENARIOS)}")
        scenario = SCENARIOS[scenario]
    made = I.inject(clean, scenario.key, scenario.injections, seed)
    dirty, issues = made.table, made.issues
    if scenario.near_duplicate_name:
        near = I.inject_near_duplicates(
            dirty, scenario.key, scenario.near_duplicate_name, scenario.near_duplicate_rate,
            _second_key, seed,
        )
        dirty, issues = near.table, issues.unionByName(near.issues)
    copied = I.inject(dirty, scenario.key, [], seed, duplicate_rate=scenario.duplicate_rate)
    dirty, issues = copied.table, issues.unionByName(copied.issues)
    golden = I.pick_golden(clean, scenario.key, scenario.golden_rows, seed)
    return Prepared(dirty, clean, issues, golden, scenario)


def _second_key(key):
    """A new text key that cannot clash with the key it is made from."""
    return F.concat(key.cast("string"), F.lit("-copy"))
