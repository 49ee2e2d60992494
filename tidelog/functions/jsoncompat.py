"""Structural compatibility of JSON bodies: a new body may only add to the current one."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def difference(current, new, path: str = "") -> str | None:
    """The path at which ``new`` isn't compatible with ``current``; None if it is.

    Objects may gain fields, and lose those whose value is null; arrays agree in length and by
    element; all else must be equal.
    """
    if isinstance(current, dict) and isinstance(new, dict):
        for key, value in current.items():
            if key not in new:
                if value is not None:
                    return f"{path}/{key}"
            elif (found := difference(value, new[key], f"{path}/{key}")) is not None:
                return found
        return None
    if isinstance(current, list) and isinstance(new, list):
        if len(current) != len(new):
            return path or "/"
        return next((d for k, (a, b) in enumerate(zip(current, new)) if (d := difference(a, b, f"{path}/{k}")) is not None), None)
    return None if type(current) is type(new) and current == new else path or "/"


def _differences(current: pd.Series, new: pd.Series) -> pd.Series:
    def one(a, b):
        a, b = (bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in (a, b))
        if a == b:
            return None
        try:
            return difference(json.loads(a), json.loads(b))
        except (ValueError, TypeError):
            return "/"

    return pd.Series([one(a, b) for a, b in zip(current, new)], dtype=object)


def json_difference(current: Column, new: Column) -> Column:
    """Path of the first difference of two bodies; null if they are compatible."""
    return F.pandas_udf(_differences, "string")(current, new)


def same_json(old: str, new: str) -> Column:
    """A compatibility predicate: equal types, and compatible bodies."""
    same = F.col(f"{old}.data") == F.col(f"{new}.data")
    return (F.col(f"{old}.event_type") == F.col(f"{new}.event_type")) & (same | json_difference(F.col(f"{old}.data"), F.col(f"{new}.data")).isNull())


def same_bytes(old: str, new: str) -> Column:
    """A compatibility predicate: equal bodies, whatever their types."""
    return F.col(f"{old}.data") == F.col(f"{new}.data")
