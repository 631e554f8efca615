"""What a run is about: read once, when the package is imported. The command line sets these from its arguments.

Queries and their SQL follow the settings alike.
"""

from __future__ import annotations

import os


def _number(name: str, default: int) -> int:
    return int(os.environ.get(f"TALLYFORGE_{name}", default))


#: Last complete year, held out by back-tests; the year after it is only partly there.
TARGET = _number("TARGET_YEAR", 2000)
#: Years that forecasts over several years look ahead.
HORIZON = _number("HORIZON", 3)
#: Methods that back-tests compare.
METHODS = tuple(sorted({"Naive", *os.environ.get("TALLYFORGE_METHODS", "Mean3,Median,Naive,Trend").split(",")}))  # the last value is what others are measured by
