"""Python functions that travel to executors by value, so that executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
