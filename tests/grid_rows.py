"""Rows and plans for the tests of the grid library."""

from datetime import date, datetime


def attempt(**changes):
    """One legal attempt row as a dict."""
    row = {
        "client_time": datetime(2026, 1, 1, 12),
        "user_id": "u1",
        "balance_id": 1001,
        "traffic_type": "organic",
        "payer_type": "payer",
        "failed": 0,
        "attempt": 1,
        "platform_name": "ios",
        "first_attempt": 1,
        "FW": 0,
        "CW": 0,
        "CF": 0,
        "FF": 0,
        "reason_seg": "unknown",
        "partition_date": date(2026, 1, 1),
        "level_cohort": 10,
        "super_ball": False,
    }
    return {**row, **changes}


def plan(df) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
