"""Small functions for mappers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_dict_value(key: str, mapper: Callable) -> Callable[[dict], dict]:
    """A function that changes one entry of a dict."""

    def change(d: dict) -> dict:
        return {**d, key: mapper(d[key])}

    return change


def map_field(struct: str, name: str, mapper: Callable[[Column], Column]) -> Column:
    """The same for a struct column."""
    return F.col(struct).withField(name, mapper(F.col(struct)[name]))
