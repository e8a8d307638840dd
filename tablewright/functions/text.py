"""Expressions on text: trimming, numbers in text, labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_TEXT = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity)\s*$"


def numeric_text(text: Column) -> Column:
    """Does the text read as a number? (Java suffixes such as 1d and 1f do not.)"""
    return text.rlike(NUMBER_TEXT)


def number_of(text: Column) -> Column:
    """The number in a text, NULL where there is none."""
    return F.when(numeric_text(text), F.trim(text).try_cast("double"))


def squeeze(text: Column) -> Column:
    """Strip, and replace each run of whitespace by one space (Unicode aware)."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def has_extra_spaces(text: Column) -> Column:
    return text.rlike(r"(?U)^\s|\s$") | text.contains("  ")


def snake_case(label: str) -> str:
    """One column label in snake_case."""
    text = label.strip()
    for pattern, replacement in fv.SNAKE_CASE_PATTERNS:
        text = re.sub(pattern, replacement, text)
    return text.lower().strip("_")


def snake_case_labels(labels: Sequence[str]) -> list[str]:
    """snake_case for all labels; a label that is already taken gets _2, _3, ..."""
    taken: set[str] = set()
    result = []
    for label in labels:
        base = snake_case(label) or "column"
        name, number = base, 1
        while name in taken:
            number += 1
            name = f"{base}_{number}"
        taken.add(name)
        result.append(name)
    return result
