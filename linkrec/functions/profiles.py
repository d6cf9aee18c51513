"""SQL expressions that compare the profiles of two people."""

from __future__ import annotations

# Fixed values.
DAYS_PER_YEAR = 365
CLOSE_CREATION_MS = 7 * 24 * 3600 * 1000
# 1 February 2016 UTC, the date account ages are counted to.  Pass
# REFERENCE_MS_PARITY instead to get the ages of a run that counts to
# 1 March 3916 UTC.
REFERENCE_MS = 1454284800000
REFERENCE_MS_PARITY = 61414934400000


def whole_years(days: str) -> str:
    """Days to whole years, cut towards zero."""
    return f"cast({days} div {DAYS_PER_YEAR} AS INT)"


def sex_code(sex1: str, sex2: str) -> str:
    """-1 unknown, 1 or 2 the same sex, 3 or 4 different by who comes first."""
    return f"""CASE WHEN {sex1} = 0 OR {sex2} = 0 THEN -1
        WHEN {sex1} = {sex2} THEN if({sex1} = 1, 1, 2)
        ELSE if({sex1} = 1, 3, 4) END"""


def created_close(created1: str, created2: str) -> str:
    """1 if both accounts were created within a week, else 0."""
    return f"if(abs({created1} - {created2}) <= {CLOSE_CREATION_MS}, 1, 0)"


def log_age(created: str, reference_ms: int = REFERENCE_MS) -> str:
    """Natural log of the account age; an account from the reference date or
    later has age 1 ms, so that its log is 0."""
    return f"ln(greatest({reference_ms} - {created}, 1))"


def same_place(place1: str, place2: str) -> str:
    """-1 if either place is unknown (0), 1 if equal, 0 if not."""
    return f"""CASE WHEN {place1} = 0 OR {place2} = 0 THEN -1
        WHEN {place1} = {place2} THEN 1 ELSE 0 END"""
