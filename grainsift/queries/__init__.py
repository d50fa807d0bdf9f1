"""The registered queries: each a Spark job and, where possible, its SQL oracle."""

from .registry import QUERIES, oracles
from . import clean, dirty, measure, profiles, rule_checks, similar, sql_text, states, stream  # noqa: F401  (they register)

__all__ = ["QUERIES", "oracles"]
