"""The comparison operators of a rule leaf, one function per value class.

Each function turns (column, operator, rule value) into a SQL predicate; rules are
compiled as text because a whole rule then costs one call into the JVM, and equal
leaves of different segments can be recognised. A predicate is NULL where the data is
NULL and NULL is no match, so a missing attribute never matches, not even for "is not"
or "does not contain".
"""

from __future__ import annotations

import math
from collections.abc import Callable

from .values import (
    RuleError,
    all_of,
    any_of,
    as_categories,
    as_instant,
    as_list,
    as_number,
    as_range,
    as_text,
    day_literal,
    instant_literal,
    number_literal,
    text_literal,
)

# The operator codes used in stored rules.
EQ, NEQ, GT, LT, GTE, LTE = "==", "!=", ">", "<", ">=", "<="
CONTAINS, NOT_CONTAINS, STARTS, ENDS = "{}", "!{}", "^=", "$="
IN, NOT_IN, BETWEEN = "()", "!()", "between"

ORDERING = (EQ, NEQ, GT, LT, GTE, LTE)
MATCHING = (CONTAINS, NOT_CONTAINS, STARTS, ENDS)
ALL_OPERATORS = (*ORDERING, *MATCHING, IN, NOT_IN, BETWEEN)

NEVER = "false"


def _ordered(column: str, op: str, literal: str) -> str:
    sign = {EQ: "=", NEQ: "<>"}.get(op, op)
    return f"{column} {sign} {literal}"


def _matched(column: str, op: str, needle: str) -> str:
    """Literal, case-insensitive substring tests."""
    function = {STARTS: "startswith", ENDS: "endswith"}.get(op, "contains")
    test = f"{function}(lower({column}), {text_literal(needle.lower())})"
    return f"NOT {test}" if op == NOT_CONTAINS else test


def _listed(column: str, op: str, literals: list[str]) -> str:
    return f"{column} {'NOT IN' if op == NOT_IN else 'IN'} ({', '.join(literals)})"


def _typed(
    column: str,
    op: str,
    value: object,
    literal: Callable[[object], str],
    text: Callable[[], tuple[str, str]],
) -> str:
    """Dispatch shared by the value classes.

    ``literal`` types one rule value, ``text`` gives subject and needle for substring tests.
    """
    if op in ORDERING:
        return _ordered(column, op, literal(value))
    if op in MATCHING:
        subject, needle = text()
        return _matched(subject, op, needle)
    if op == BETWEEN:
        low, high = as_range(value)
        return f"{column} BETWEEN {literal(low)} AND {literal(high)}"
    if op in (IN, NOT_IN):
        return _listed(column, op, [literal(item) for item in as_list(value)])
    raise RuleError(f"unknown operator {op!r}")


def compare_text(column: str, op: str, value: object) -> str:
    return _typed(column, op, value, lambda v: text_literal(as_text(v)), lambda: (column, as_text(value)))


def compare_code(column: str, op: str, value: object) -> str:
    """Select attributes: integer codes; a value that is no number matches nobody."""
    if op in MATCHING:
        return _matched(f"CAST({column} AS STRING)", op, as_text(value))
    return compare_number(column, op, value)


def compare_number(column: str, op: str, value: object) -> str:
    """Numbers are compared as doubles."""
    column = f"CAST({column} AS DOUBLE)"
    if op in (IN, NOT_IN):
        numbers = [number_literal(n) for n in map(as_number, as_list(value)) if n is not None]
        if not numbers:
            return f"{column} IS NOT NULL" if op == NOT_IN else NEVER
        return _listed(column, op, numbers)
    if op == BETWEEN:
        low, high = map(as_number, as_range(value))
        if low is None or high is None:
            return NEVER
        return f"{column} BETWEEN {number_literal(low)} AND {number_literal(high)}"
    if op not in ORDERING:
        raise RuleError(f"operator {op!r} needs text, not a number")
    number = as_number(value)
    return NEVER if number is None else _ordered(column, op, number_literal(number))


def _dated(column: str, op: str, value: object, literal: Callable[[object], str]) -> str:
    if not isinstance(value, (list, tuple)) and as_text(value) == "":
        return NEVER
    as_string = f"CAST({column} AS STRING)"
    return _typed(column, op, value, literal, lambda: (as_string, as_instant(value).date().isoformat()))


def compare_day(column: str, op: str, value: object) -> str:
    """Calendar dates; every rule value is cut to its day."""
    return _dated(column, op, value, lambda v: day_literal(as_instant(v)))


def compare_at_midnight(column: str, op: str, value: object) -> str:
    """Timestamps against midnight of the rule value's day."""
    midnight = {"hour": 0, "minute": 0, "second": 0, "microsecond": 0}
    return _dated(column, op, value, lambda v: instant_literal(as_instant(v).replace(**midnight)))


def compare_order_date(column: str, op: str, value: object) -> str:
    """(In)equality looks at the day; before/after/between look at the instant."""
    if op in (EQ, NEQ):
        return _ordered(f"CAST({column} AS DATE)", op, day_literal(as_instant(value)))
    if op in (GT, LT, GTE, LTE, BETWEEN):
        return _typed(column, op, value, lambda v: instant_literal(as_instant(v)), lambda: (column, ""))
    raise RuleError(f"operator {op!r} does not apply to order dates")


def compare_order_text(column: str, op: str, value: object) -> str:
    """Row-level test on an order's text column, used under EXISTS."""
    values = as_list(value)
    if op in (EQ, NEQ):
        return _ordered(column, op, text_literal(values[0]))
    if op in (IN, NOT_IN):
        return compare_text(column, op, values)
    if op in (CONTAINS, NOT_CONTAINS):
        return _matched(column, op, values[0])
    raise RuleError(f"operator {op!r} does not apply to order history")


def compare_sku_list(column: str, op: str, value: object) -> str:
    """SKU in / not in a list, or like any / like none of it."""
    values = as_list(value)
    if op in (EQ, NEQ):
        return compare_text(column, IN if op == EQ else NOT_IN, values)
    if op == CONTAINS:
        return any_of([_matched(column, op, v) for v in values])
    if op == NOT_CONTAINS:
        return all_of([_matched(column, op, v) for v in values])
    raise RuleError(f"operator {op!r} does not apply to purchased products")


def compare_cart_sku(column: str, op: str, value: object) -> str:
    """Case-folded SKU test with a trimmed needle."""
    needle = as_text(value).strip().lower()
    if op in (EQ, NEQ):
        return _ordered(f"lower({column})", op, text_literal(needle))
    if op in (CONTAINS, NOT_CONTAINS):
        return _matched(column, op, needle)
    raise RuleError(f"operator {op!r} does not apply to cart products")


def listed_values(
    comparison: Callable[[str, str, object], str], column: str, op: str, value: object
) -> tuple[str | None, tuple]:
    """When a row-level test says "key is one of values": that key and those values."""
    if comparison is compare_order_text and op in (EQ, IN):
        values = as_list(value)
        return column, tuple(values[:1] if op == EQ else values)
    if comparison is compare_sku_list and op == EQ:
        return column, tuple(as_list(value))
    if comparison is compare_cart_sku and op == EQ:
        return f"lower({column})", (as_text(value).strip().lower(),)
    if comparison is compare_category and op == EQ:
        values = tuple(as_categories(value))
        return (f"CAST({column} AS BIGINT)", values) if values else (None, ())
    return None, ()


#: Ages in days beyond which no timestamp can lie.
OLDEST = 4_000_000


def age_steps(op: str, value: object) -> tuple[int, ...]:
    """The whole ages from which on a comparison of an age with a number has another answer than before."""
    number = as_number(value)
    if number is None or abs(number) > OLDEST:
        return ()
    if op in (EQ, NEQ):
        return (int(number), int(number) + 1) if number == int(number) else ()
    return (math.floor(number) + 1,) if op in (GT, LTE) else (math.ceil(number),)


def reached_at(moment: str, age: int) -> str:
    """When something of ``moment`` is ``age`` days old; ages are cut towards zero, so those up to 0 begin behind an instant."""
    if age >= 1:
        return f"{moment} + make_dt_interval({age})"
    return f"{moment} + make_dt_interval({age - 1}, 0, 0, 0.000001)"


def compare_category(column: str, op: str, value: object) -> str:
    """Category in / not in a list of ids; an item that is no number counts as id 0.

    An item that no id can be equal to (infinite, or beyond 64 bits) matches nothing, and every id is another.
    """
    ids = [str(number) for number in as_categories(value)]
    if op in (EQ, NEQ):
        if not ids:
            return NEVER if op == EQ else f"{column} IS NOT NULL"
        return _listed(column, IN if op == EQ else NOT_IN, ids)
    raise RuleError(f"operator {op!r} does not apply to categories")
