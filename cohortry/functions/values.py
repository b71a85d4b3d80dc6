"""Reading rule values: untyped JSON scalars or lists become typed SQL literals.

This runs on the driver, once per rule leaf, while the rule becomes an expression.
"""

from __future__ import annotations

import datetime as dt
import re


class RuleError(ValueError):
    """The rule cannot be evaluated: unknown leaf, operator, or value format."""


_WHOLE = re.compile(r"\s*[+-]?\d{1,4000}\s*")
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")
# Text that every setting of the SQL parser reads as it stands: no quote, no escape
# character, no variable reference, no control character.
_PLAIN = re.compile(r"[^'\\$\x00-\x1f]*")


def as_text(value: object) -> str:
    if isinstance(value, bool):
        return "1" if value else ""
    return "" if value is None else str(value)


def as_list(value: object) -> list[str]:
    """A list, or a comma-separated string; items are trimmed."""
    items = value if isinstance(value, (list, tuple)) else as_text(value).split(",")
    return [as_text(item).strip() for item in items]


def as_number(value: object) -> float | None:
    """The number a scalar stands for, or None when it is not numeric."""
    text = as_text(value)
    return float(text) if _NUMBER.fullmatch(text) else None


def as_range(value: object) -> tuple[str, str]:
    items = as_list(value)
    if len(items) < 2:
        raise RuleError(f"a range needs two values, got {value!r}")
    return items[0], items[1]


def as_category(value: str) -> int | None:
    """The id an item stands for: 0 where it is no number, None where no 64-bit id can be equal to it."""
    if as_number(value) is None:
        return 0
    try:
        number = int(value) if _WHOLE.fullmatch(value) else int(float(value))
    except OverflowError:
        return None
    return number if -(1 << 63) <= number < 1 << 63 else None


def as_categories(value: object) -> list[int]:
    """The ids of a list that some row may have."""
    return [number for number in map(as_category, as_list(value)) if number is not None]


def as_instant(value: object) -> dt.datetime:
    try:
        parsed = dt.datetime.fromisoformat(as_text(value).strip())
        if parsed.tzinfo is not None:
            parsed = parsed.astimezone(dt.timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError):
        raise RuleError(f"not a date: {value!r}") from None
    return parsed


def text_literal(text: str) -> str:
    """A string literal. Anything a parser could take for syntax is passed as bytes."""
    try:
        text.encode()
    except UnicodeEncodeError:
        raise RuleError(f"not a text: {text!r}") from None
    if _PLAIN.fullmatch(text):
        return f"'{text}'"
    return f"CAST(X'{text.encode().hex()}' AS STRING)"


def number_literal(number: float) -> str:
    return f"CAST('{number!r}' AS DOUBLE)"


def instant_literal(moment: dt.datetime) -> str:
    """A zone-free timestamp; a constant, so filters on it reach the scan."""
    return f"TIMESTAMP_NTZ '{moment.isoformat(sep=' ')}'"


def day_literal(moment: dt.datetime) -> str:
    return f"DATE '{moment.date().isoformat()}'"


def any_of(tests: list[str]) -> str:
    return " OR ".join(f"({test})" for test in tests)


def all_of(tests: list[str]) -> str:
    return " AND ".join(f"({test})" for test in tests)
