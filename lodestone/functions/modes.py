"""Names of comparison and order modes, one table for parsing, building and rewriting actions."""

from __future__ import annotations

import re

# What the modes of a comparison are called.
COMPARISONS = {
    "<": "lt", "lt": "lt", "less than": "lt", "lessthan": "lt",
    "<=": "le", "le": "le", "less equal": "le", "lessequal": "le", "less than or equal": "le", "less than or equal to": "le", "lessthanorequal": "le", "at most": "le",
    ">": "gt", "gt": "gt", "greater than": "gt", "greaterthan": "gt",
    ">=": "ge", "ge": "ge", "greater equal": "ge", "greaterequal": "ge", "greater than or equal": "ge", "greater than or equal to": "ge", "greaterthanorequal": "ge", "at least": "ge",
}
# Names of equality, which can be rewritten but not built.
EQUALITIES = {"=": "eq", "eq": "eq", "equal": "eq", "equals": "eq", "equal to": "eq", "!=": "ne", "ne": "ne", "neq": "ne", "not equal": "ne", "not equal to": "ne"}
# What the modes of an order are called.
ORDERS = {"max": "ARGMAX", "argmax": "ARGMAX", "arg max": "ARGMAX", "maximum": "ARGMAX", "largest": "ARGMAX", "min": "ARGMIN", "argmin": "ARGMIN", "arg min": "ARGMIN", "minimum": "ARGMIN", "smallest": "ARGMIN"}
# The comparison modes in words.
MODE_WORDS = {"le": "LESS EQUAL", "ge": "GREATER EQUAL", "lt": "LESS THAN", "gt": "GREATER THAN"}


def mode_key(name: str) -> str:
    """name as it stands in the tables."""
    return re.sub(r"\s+", " ", name.strip().lower().replace("_", " "))
