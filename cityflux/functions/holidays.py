"""United States federal holidays as one boolean expression (rules of 1986 on)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed-date holidays as month * 100 + day (fixed values); Juneteenth since 2021.
FIXED_DATES = (101, 704, 1111, 1225)
JUNETEENTH, JUNETEENTH_SINCE = 619, 2021
# Weekday holidays: weekday (Monday = 0), first and last possible date (fixed values).
FLOATING = (
    (0, 115, 121),
    (0, 215, 221),
    (0, 525, 531),
    (0, 901, 907),
    (0, 1008, 1014),
    (3, 1122, 1128),
)


def _month_day(day: str) -> str:
    return f"(month({day}) * 100 + day({day}))"


def _fixed(day: str) -> str:
    dates = ", ".join(str(d) for d in FIXED_DATES)
    return (
        f"({_month_day(day)} IN ({dates}) "
        f"OR ({_month_day(day)} = {JUNETEENTH} AND year({day}) >= {JUNETEENTH_SINCE}))"
    )


def is_federal_holiday(ts: str) -> Column:
    """The day itself, or its observed Friday / Monday when it falls on a weekend."""
    day = f"to_date(`{ts}`)"
    rules = [
        _fixed(day),
        f"(weekday({day}) = 0 AND {_fixed(f'date_sub({day}, 1)')})",
        f"(weekday({day}) = 4 AND {_fixed(f'date_add({day}, 1)')})",
    ]
    rules += [
        f"(weekday({day}) = {dow} AND {_month_day(day)} BETWEEN {first} AND {last})"
        for dow, first, last in FLOATING
    ]
    return F.expr(" OR ".join(rules))
