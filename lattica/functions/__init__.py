"""The formula language: parsing, lowering to Columns, and the function library."""

from lattica.functions import arrays, dates, finance, logic, mathematics, statistics, text  # noqa: F401  (they register)
from lattica.functions.core import E, REGISTRY, lit
from lattica.functions.lower import lower, row_formula
from lattica.functions.parser import parse

__all__ = ["E", "REGISTRY", "lit", "lower", "parse", "row_formula"]
