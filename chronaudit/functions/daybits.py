"""Sets of days within a year as bits.

The days on which a group has rows fit into six 64-bit words per year. ``bit_or``
gathers them in a hash aggregate with a buffer of fixed size: partial aggregation
leaves one short row per group and year in each task, however many rows a group has,
and one shuffle is enough.

Word ``i`` of a set named ``p`` is the column ``p_i``; it holds days of the year
64 i + 1 to 64 i + 64.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = 6


def names(prefix: str) -> list[str]:
    return [f"{prefix}_{i}" for i in range(WORDS)]


def slot(day: str) -> str:
    """Place of a day in its year, from 0. To be computed once, ahead of ``gather``."""
    return f"dayofyear({day}) - 1"


def gather(prefix: str, slot: str, condition: str = "true") -> list[Column]:
    """Aggregates that gather the days at a slot column where the condition holds."""
    return [
        F.expr(
            f"coalesce(bit_or(case when shiftright({slot}, 6) = {i} and {condition}"
            f" then shiftleft(1L, {slot} & 63) end), 0L)"
        ).alias(name)
        for i, name in enumerate(names(prefix))
    ]


def member(prefix: str, day: str) -> str:
    """The day is in the set."""
    place = f"(dayofyear({day}) - 1)"
    whens = " ".join(f"when {i} then {name}" for i, name in enumerate(names(prefix)))
    word = f"(case shiftright({place}, 6) {whens} end)"
    return f"(shiftrightunsigned({word}, {place} & 63) & 1L) = 1"


def _any(pairs: list[str]) -> str:
    return "(" + " | ".join(pairs) + ") <> 0L"


def some_absent(due: str, present: str) -> str:
    """Some day of one set is not in the other."""
    return _any([f"({d} & ~{p})" for d, p in zip(names(due), names(present))])


def some_shared(due: str, present: str) -> str:
    """Some day of one set is in the other as well."""
    return _any([f"({d} & {p})" for d, p in zip(names(due), names(present))])

