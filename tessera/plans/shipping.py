"""Functions of this package in tasks, on executors that do not have it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """From now on the functions of a module go to the tasks as code, not as names to import there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def decade_of(year):
    """The first year of a year's decade, of numbers or of a column of them."""
    return year // 10 * 10
